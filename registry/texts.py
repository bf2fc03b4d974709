"""Lines of the trial-balance documents. Runs inside Python workers on Arrow columns, all lines of a batch at once."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# workers get these few functions with the job and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_GROUPS = pa.array([f"{n:03d}" for n in range(1000)])
_HEADS = pa.array([str(n) for n in range(1000)])
_CENTS = pa.array([f",{n:02d}" for n in range(100)])


def _joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _whole(values: np.ndarray) -> pa.Array:
    """Whole numbers with a dot before every three digits."""
    if not (values > 999).any():
        return _HEADS.take(pa.array(values))
    rest, last = np.divmod(values, 1000)
    long = rest > 0
    text = _joined(_whole(rest), ".", _GROUPS.take(pa.array(last)))
    return pc.if_else(pa.array(long), text, _HEADS.take(pa.array(last)))


def br(cents: pa.Array) -> pa.Array:
    """123456 as ``1.234,56``."""
    # most amounts of a trial balance are nought, and are written once
    value = pc.fill_null(cents, 0).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(value)
    whole, small = np.divmod(np.abs(value[some]), 100)
    signs = pc.if_else(pa.array(value[some] < 0), "-", "")
    written = pa.concat_arrays([pa.array(["0,00"]), _joined(signs, _whole(whole), _CENTS.take(pa.array(small)))])
    place = np.zeros(len(value), np.int64)
    place[some] = np.arange(1, len(some) + 1)
    return written.take(pa.array(place, mask=cents.is_null().to_numpy(zero_copy_only=False)))


def body(rows: pa.Array, status: pa.Array) -> pa.Array:
    """The account lines of each document as one text, in the layout of its status; a line without an amount is left out."""
    sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    number, code, name, nature, before, moved, after = pc.list_flatten(rows).flatten()
    own = np.repeat(np.arange(len(rows)), sizes)
    nought = pa.scalar(0, pa.int64())
    debit_side = pc.equal(nature, "D")
    debit, credit = br(pc.if_else(debit_side, moved, nought)), br(pc.if_else(debit_side, nought, moved))
    prior, amount = br(before), br(after)
    prior_nature = pc.if_else(pc.not_equal(before, 0), nature, "")
    kind = status.fill_null("").take(pa.array(own))
    forms = {
        "F": (amount, nature, credit, debit, prior, number, " ", name),
        "O": (number, " ", name, "  ", prior, "  ", debit, "  ", credit, "  ", amount, nature),
        "P": (number, " ", code, " ", amount, nature, prior, prior_nature, " ", debit, " ", credit, name),
    }
    lines, places = [], []
    rest = np.ones(len(own), bool)
    for form, parts in forms.items():
        chosen = rest if form == "P" else pc.equal(kind, form).to_numpy(zero_copy_only=False)
        rest = rest & ~chosen
        mask = pa.array(chosen)
        lines.append(_joined(*[p if isinstance(p, str) else p.filter(mask) for p in parts]))
        places.append(np.flatnonzero(chosen))
    written = pa.concat_arrays(lines).take(pa.array(np.argsort(np.concatenate(places), kind="stable")))
    kept = written.is_valid()
    counts = np.bincount(own[kept.to_numpy(zero_copy_only=False)], minlength=len(rows))
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, written.filter(kept)), "\n")
