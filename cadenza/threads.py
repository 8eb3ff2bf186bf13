"""One thread for dense algebra. The systems here are small; more threads only compete with Spark's for the cores."""

from __future__ import annotations

import ctypes
import os


def single_threaded() -> None:
    """For a library not loaded yet by the environment, for a loaded one by its own switch; elsewhere nothing happens."""
    for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    try:
        with open("/proc/self/maps") as f:
            loaded = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in loaded:
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break
