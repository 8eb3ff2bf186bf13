"""Operators do the whole job at any size."""

import pytest

from cadenza.llm import suffix_dedup
from tests.llm.test_exact import frame, plain_cuts, repeated


@pytest.mark.parametrize("ends", [[], [-(2**63) + 1, 2**63 - 1]])
def test_suffix_dedup_of_null_ids_in_parts_of_ranges(spark, monkeypatch, ends):
    monkeypatch.setattr(suffix_dedup, "RANGE", 4)
    rows = repeated(5)
    rows += [(None, rows[7][1] + " and more"), (None, rows[40][1]), *[(e, rows[9][1] + "?") for e in ends]]
    assert sorted(str(tuple(r)) for r in suffix_dedup.digests(frame(spark, rows), 1e3).collect()) == plain_cuts(rows)
