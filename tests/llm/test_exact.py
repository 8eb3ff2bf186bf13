"""Operators with an exact answer, against brute force on small tables."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import bpe, common, decontam, jaccard, outliers, suffix_dedup, tokencount, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "some words in a row here"), (5, long), (6, long), (7, " \n\t "), (8, "Ünï  \n \n 漢字🙂 'll it's"), (9, "\x00\x1c x　y")]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        for c in ("lang", "source", "score", "n_tokens", "g", "id", "value", "rows", "component_id", "_y"):
            df = df.withColumn(c, F.lit("x"))
        df = df.withColumn("n_chars", F.length("text").cast("bigint"))
    return df


def plain_sets(rows):
    out = []
    for _, t in rows:
        w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


# ---- byte-level BPE ------------------------------------------------------------------------------------------------


def encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library():
    e = encoding()
    with open(RANKS, "rb") as f:
        m = bpe.encoder(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", " ", "\n", "'s", "1", "é", "漢", "🙂", "\x1c", "\x85", " ", "　", "aaa", "  ", "!", "the", "\x00", "zzzzzzz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["a" + chr(c) + "1" + chr(c) * 2 + " b" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    got = m.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.encode_ordinary(t) for t in texts]
    assert [m.decode(x).decode() for x in got] == texts


@pytest.mark.parametrize("extra", [False, True])
def test_bpe_query(spark, extra):
    e = encoding()
    rows = odd_rows()
    got = bpe.digests(frame(spark, rows, extra), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for d, t in rows:
        ids = e.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bpe_replaces_columns_of_its_names(spark):
    df = frame(spark, odd_rows(), True).selectExpr("*", "'mine' as ids", "1 as Decoded_SHA256")
    out = bpe.tokens(df, RANKS, public_tokenizers.PATTERN)
    assert [c.lower() for c in out.columns] == [c.lower() for c in df.columns if c.lower() not in ("text", "ids", "n_tokens", "decoded_sha256")] + ["ids", "n_tokens", "decoded_sha256"]
    assert out.count() == len(odd_rows()) and bpe.encode(df, RANKS, public_tokenizers.PATTERN).columns.count("ids") == 1
    assert bpe.digests(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_columns_round_trip(spark):
    df = frame(spark, odd_rows(), True)
    back = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t in odd_rows())


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def test_deep_shallow_order():
    rng = np.random.default_rng(1)
    for trial in range(24):
        t = rng.integers(0, 2 + trial % 3, 2000).astype(np.uint8) * 100
        if trial % 2:
            t[1000:1500] = t[200:700]
        if trial % 5 == 0:
            t[:] = 0
        text, starts, d = np.append(t, np.zeros(80, np.uint8)), rng.choice(1900, 900, replace=False), [50, 7, 16, 23][trial % 4]
        slot = suffix_dedup.deep_shallow(text, starts, d)
        keys = [text[i : i + d].tobytes() for i in starts]
        first = {}
        for i, k in enumerate(sorted(keys)):
            first.setdefault(k, i)
        assert [first[k] for k in keys] == slot.tolist()


def plain_cuts(rows):
    least = {}
    key = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(key(d), least.get(w, 2**63))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < key(d):
                cut[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        runs = sum(1 for i, c in enumerate(cut) if c and (not i or not cut[i - 1]))
        out.append((d, len(b), sum(cut), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def repeated(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(120):
        p = rng.choice(passages)
        a = rng.randrange(250)
        t = "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(150))) + p[a : rng.randint(a, 300)] + "".join(rng.choice("xyz ") for _ in range(rng.randrange(100)))
        if i % 7 == 1:
            t = "ab" * rng.randrange(150)
        if i % 7 == 3 and rows:
            t = rng.choice(rows)[1] or "q"
        rows.append((rng.choice([i * 3, i * 3, 9]), t))
    return rows


@pytest.mark.parametrize(("group", "wide", "narrow"), [(2e3, 20_000, 20_000), (4e3, 2, 20_000), (1e9, 20_000, 20_000), (4e3, 20_000, 1), (9e3, 3, 2)])
def test_suffix_dedup_equals_brute_force(spark, group, wide, narrow):
    """Where an anchor counts as wide is a matter of cost: the rows are the same at any of these limits."""
    rows = repeated(5)
    assert sorted(str(tuple(r)) for r in suffix_dedup.digests(frame(spark, rows), group, wide, narrow).collect()) == plain_cuts(rows)


def test_suffix_dedup_odd_rows(spark):
    rows = odd_rows()
    assert sorted(str(tuple(r)) for r in suffix_dedup.digests(frame(spark, rows, True), 5e4).collect()) == plain_cuts(rows)
    out = suffix_dedup.dedup(frame(spark, rows, True))
    assert out.columns == frame(spark, rows, True).columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[6].text == "" and got[6].n_chars == 0 and got[1].text is None and got[5].text == odd_rows()[5][1]
    assert suffix_dedup.digests(frame(spark, [])).count() == 0 == suffix_dedup.dedup(frame(spark, [])).count()


# ---- n-gram join ---------------------------------------------------------------------------------------------------


def plain_components(rows):
    sets = plain_sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(least.get(find(i), 2**63), d)
    return sorted(str((d, len(sets[i]), least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def near(seed):
    rng = random.Random(seed)
    voc = [f"W{i}" for i in range(60)]
    rows = []
    for i in range(200):
        if rows and i % 3:
            w = (rng.choice(rows)[1] or "x y").split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(voc)
            t = " ".join(w + (rng.choices(voc, k=rng.randrange(9)) if i % 5 == 0 else []))
        else:
            t = None if i % 11 == 0 else "A b" if i % 13 == 0 else "The " + "\n".join(rng.choices(voc, k=rng.randint(1, 60)))
        rows.append((i * 7 % 2003, t))
    return rows


@pytest.mark.parametrize("block", [1500, 7])
def test_jaccard_equals_brute_force(spark, block):
    rows = near(4)
    assert sorted(str(tuple(r)) for r in jaccard.classes(frame(spark, rows), block).collect()) == plain_components(rows)


def test_jaccard_odd_rows(spark):
    rows = odd_rows()
    df = frame(spark, rows, True)
    assert sorted(str(tuple(r)) for r in jaccard.classes(df).collect()) == plain_components(rows)
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d != 6)
    assert jaccard.classes(frame(spark, [])).count() == 0


def test_jaccard_of_null_and_repeated_ids(spark):
    rng = random.Random(9)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = words(60), words(70), words(50)
    text = " ".join
    rows = [(1, text(a)), (None, text(a + ["x", "y"])), (None, text(b)), (None, text([*b, "u"])), (5, text([*b, "u", "w"]))]
    rows += [(7, text(c)), (7, text(b[:35])), (9, text([*b[:35], "k"])), (3, text([*c, "j"])), (7, text(c)), (None, text(words(40))), (None, None)]
    got = sorted(str(tuple(r)) for r in jaccard.classes(frame(spark, rows, True)).collect())
    assert got == plain_components(rows) and str((None, 58, 1)) in got and str((9, 32, 7)) in got
    kept = [(r.doc_id, r.text) for r in jaccard.keep_first(frame(spark, rows, True)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [rows[0], rows[4], rows[6], rows[8], rows[10], rows[11]]))


def test_shingles_common_to_a_batch(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 3)
    rows = near(11)
    same = " ".join(f"s{i}" for i in range(40))
    rows += [(3000 + i, f"{same} t{i} u{i}") for i in range(60)]
    df = frame(spark, rows)
    shared = {r.p40: r.shared for r in jaccard._shared(df, 3).collect()}
    sets = jaccard.Sets(pa.array([t for _, t in rows], pa.string()))
    p, _ = sets.prints()
    h, d = sets.parts()
    holders = {}
    for x, i in zip((h >> np.uint64(16)).tolist(), d.tolist(), strict=True):
        holders.setdefault(x, set()).add(int(p.view(np.uint64)[i] >> np.uint64(24)))
    want = {}
    for who in holders.values():
        for c in who if len(who) > 1 else ():
            want[c] = want.get(c, 0) + 1
    assert all(shared.get(c, 0) >= n for c, n in want.items())  # never fewer, so nothing that links is dropped
    assert sorted(str(tuple(r)) for r in jaccard.classes(df).collect()) == plain_components(rows)


def test_merge_skip():
    rng = random.Random(3)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(20))) for _ in range(rng.randrange(1, 9))]
        least = rng.randrange(1, 7)
        want = [(d, n) for d in range(40) if (n := sum(d in x for x in lists)) >= least]
        assert jaccard.merge_skip(lists, least) == want


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.append(s[: len(s) * 9 // 10], rng.integers(0, 400, 3).astype(np.uint64))) for s in sets[:120]]
    off = np.append(0, np.cumsum([len(s) for s in sets]))
    index = jaccard.Index(np.concatenate(sets), off)
    for s in sets:
        want = [j for j, o in enumerate(sets) if 7 * len(np.intersect1d(s, o)) >= 3 * (len(s) + len(o))]
        assert index.search(s).tolist() == want


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 10), (7, 7)], "a bigint, b bigint")
    assert sorted(map(tuple, common.components(e).collect())) == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8), (10, 3)]


# ---- WARC ----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = [(1, "u", "<p>a"), (2, "u\nv", "<p>a"), (3, None, None), (4, "u", ""), (5, "u", "é" * 5000), (None, "u", "<p>a"), (7, "u", "x"), (7, "u", "x")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "1 as payload", "'z' as sha")
    at = warc.write_archives(df)
    got = warc.read_archives(spark, at).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(p[0]) for p in pages)
    most = {}
    for p, _, h in pages:
        if p is not None:
            most[h or ""] = max(most.get(h or "", p), p)
    for r in got:
        html = next(h or "" for p, _, h in pages if p == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == warc.base32_sha1(html.encode())
        first = r.page_id == most[html]
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", most[html]))
        assert r.payload == (html.encode() if first else None)
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(empty).count() == 0


def test_warc_archives_are_bounded_and_repeatable(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "u", "".join(rng.choice("abcdefgh<>") for _ in range(4000))) for i in range(60)], "page_id bigint, url string, html string").coalesce(1)
    assert warc.dictionary(df) == warc.dictionary(df.orderBy(F.desc("page_id")))
    at = warc.write_archives(df, archive_bytes=20_000)
    sizes = [r.length for r in spark.read.format("binaryFile").load(at).select("length").collect()]
    assert len(sizes) > 3 and max(sizes) < 20_000 + 4000 + warc.DICTIONARY_BYTES
    assert sorted(r.page_id for r in warc.read_archives(spark, at).collect()) == list(range(60))


def test_warc_damage_is_found():
    import zstandard

    rec = warc.record(1, "u", b"abc", warc.base32_sha1(b"abc"), None)
    assert warc.parse(rec)["payload"] == b"abc"
    for bad in (rec[:-1], rec.replace(b"abc", b"abd"), rec.replace(b"WARC/1.1", b"WARC/9"), rec.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    words = zstandard.ZstdCompressionDict(b"some words that pages share " * 50)
    frame_ = zstandard.ZstdCompressor(dict_data=words, write_checksum=True).compress(rec)
    data = warc.skippable(warc.DICTIONARY, words.as_bytes()) + frame_ + warc.NEWLINE_FRAME + b"\n" + frame_
    assert list(warc.records(data)) == [rec, rec]
    with pytest.raises(ValueError):
        list(warc.records(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.records(frame_[:0] + b"\1\2\3\4\5\6\7\10"))


# ---- token counts --------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        pieces = tokencount.read_pieces(f.read())
    lib = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(f"<0x{k:02X}>", -1e12) for k in range(256)] + list(pieces.items()), unk_id=0, byte_fallback=True))

    def want(t):
        return sum(len(lib.encode(w, add_special_tokens=False).tokens) for w in re.findall("▁+[^▁]*", "▁" + t.replace(" ", "▁"))) if t else 0

    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", "the", "ing", "é", "漢", "🙂", "▁", "字", "A", ".", "hello", "\t", "0", "<s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)]
    assert tokencount.Counter(pieces).texts(pa.array(texts)).tolist() == [want(t) for t in texts]
    rows = [r for r in odd_rows() if "\x00" not in (r[1] or "")]
    got = tokencount.token_counts(frame(spark, rows, True), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), want(t or "")) for d, t in rows)
    assert tokencount.token_counts(frame(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# ---- decontamination -----------------------------------------------------------------------------------------------


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    item = lambda n: "".join(rng.choice("abcdefghij  ") for _ in range(n)).strip() + "z"
    items = [(i, item(rng.randint(10, 120))) for i in range(12)] + [(20, "abcdefghijzyx"), (21, "zyxw"), (22, "q" * 19), (50, None), (51, "")]
    rows = [(100, "a bcdefghijzyx"), (101, "abcdefghijzy"), (102, "abcdefhijzy"), (103, "uzyxwu"), (104, "zyx"), (105, "q" * 18), (106, "Q" * 17), (107, "qq" + "q" * 7 + "x" + "q" * 9)]
    for d in range(60):
        t = list(decontam.normal(items[d % 12][1]))
        for _ in range(rng.randrange(14)):
            k = rng.randrange(len(t))
            t[k : k + 1] = [[], ["q"], [t[k], "r"]][rng.randrange(3)]
        rows.append((d, item(rng.randrange(200)) + " " + "".join(t).upper() + "\n " + item(rng.randrange(200))))
    m = decontam.Matcher(items)
    want = set()
    for d, t in rows:
        for it in m.items:
            e = plain_distance(it.text, decontam.normal(t))
            assert it.budget == len(it.text) // 10
            if e <= it.budget:
                want.add((d, it.item_id, e))
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    got = {tuple(r) for r in decontam.hits(frame(spark, rows, True), bench, block=5).collect()}
    assert got == want and len(want) > 10
    bad = {d for d, _, _ in decontam.hits(frame(spark, rows), bench).collect()}
    assert {100, 101, 103, 105, 107} <= bad and not {102, 104, 106} & bad
    assert {r.doc_id for r in decontam.clean(frame(spark, rows, True), bench).collect()} == {d for d, _ in rows} - bad
    assert decontam.hits(frame(spark, odd_rows()), bench.limit(0)).count() == 0 == decontam.report(frame(spark, []), bench).count()


# ---- quality rules -------------------------------------------------------------------------------------------------


def plain_counts(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    rep = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [t for _, t in odd_rows()] + ["\n".join(" ".join(rng.choice(["a", "b|", "#c", "é"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12))) for _ in range(200)]
    c = outliers.counts(pa.array(texts, pa.string()))
    assert list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)) == [plain_counts(t) for t in texts]


def plain_mcd(x, picks, share):
    """The estimate of one group by the same starts, with exact subsets, in numpy."""
    floor = np.diag(np.array(list(outliers.FLOOR.values())) ** 2)
    c = outliers.consistency(share, x.shape[1])

    def estimate(rows):
        return rows.mean(0), np.cov(rows.T, bias=True) * c + floor * (1 + outliers.LEAST / len(rows))

    med = np.median(x, 0)
    starts = [(med, np.diag((1.4826 * np.median(abs(x - med), 0)) ** 2) + floor), estimate(x)]
    starts += [estimate(x[picks % 10 == k]) for k in range(outliers.DRAWS) if (picks % 10 == k).any()]
    best = None
    for m, v in starts:
        for _ in range(100):
            d = ((x - m) @ np.linalg.inv(v) * (x - m)).sum(1)
            m, v = estimate(x[d <= np.sort(d)[int(np.ceil(share * len(x))) - 1]])
        if best is None or np.linalg.slogdet(v)[1] < best[0]:
            best = np.linalg.slogdet(v)[1], m, v
    return best


def test_mcd_equals_plain_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 5)) @ rng.normal(0, 1, (5, 5)) + 3
    x[:60] = x[:60] * 0.1 + 40  # a cluster of outliers, which a plain covariance takes in
    picks = rng.integers(0, 1000, 400)
    df = spark.createDataFrame([("g", int(p), *map(float, r)) for p, r in zip(picks, x, strict=True)], ["grp", "pick", *outliers.FEATURES])
    got = outliers.mcd(df, 1).collect()[0]
    det, m, v = plain_mcd(x, picks, outliers.SHARE)
    assert abs(got.det - det) < 0.05 and np.allclose([got[f"m_{k}"] for k in outliers.FEATURES], m, atol=0.1)
    inverse = np.linalg.inv(v)
    assert np.allclose([got[f"i_{k}_{k}"] for k in outliers.FEATURES], np.diag(inverse), rtol=0.1)


def test_screen(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 300)))) for i in range(300)]
    rows += [(1000 + i, " ".join("#|%" + "x" * rng.randint(1, 3) for _ in range(100 + i))) for i in range(8)] + [(2000, "few words"), (2001, None)]
    df = frame(spark, rows, True)
    got = {r.doc_id: r for r in outliers.screen(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(300)) and not any(got[1000 + i].kept for i in range(8))
    assert got[2000].base_failed and not got[2001].kept
    alone = outliers.screen(frame(spark, rows[:30], True)).collect()
    assert all(r.kept and r.distance < 60 for r in alone)  # judged by an estimate of those 30
    assert outliers.screen(frame(spark, rows[-2:], True)).where("kept").count() == 0
    # one source of another language with few texts is judged too, by the whole corpus
    few = frame(spark, [*rows[:4], *rows[300:303]], True).withColumn("lang", F.lit("other"))
    both = outliers.screen(frame(spark, rows[:200], True).unionByName(few)).where("distance is not null").collect()
    assert len(both) == 207 and sum(not r.kept for r in both if r.doc_id >= 1000) == 3
    assert outliers.screen(frame(spark, [], True)).count() == 0
