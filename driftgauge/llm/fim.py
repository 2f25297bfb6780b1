"""Fill-in-middle transformation by block rotation in place.

A text is cut into lines; two seeded digests of doc_id say after which line the prefix and the middle end. The three segments, each behind its
sentinel, are laid out in one bytearray in the order of the text. Two neighbouring blocks change places by three reversals of that buffer (each block, then
both together), so no second copy of the text is built:

* psm: prefix, then the blocks middle and suffix change places;
* spm: prefix and middle are one block, which changes places with suffix.

`restore` finds the sentinels in an output, rotates back by the same reversals and takes the sentinels out again.

Nothing is shuffled: every row is a step of its own inside its Arrow batch, and batches are bounded by rows and by Spark's own limits.

Defined cases: a null text counts as empty; an empty text is plain, with an empty output; a text that holds a sentinel is plain, so an output is
always read back without doubt; a null doc_id has the digest of `null`; equal rows get equal results; no rows, no results; extra columns pass through, and
columns that are named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm.common import flat, unused

#: Prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
RESULTS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
           T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def draws(seed: int, doc_id: str = "doc_id") -> list[Column]:
    """The first four unsigned 32-bit numbers of a digest of doc_id."""
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(hexes, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def reverse(view: np.ndarray, start: int, stop: int) -> None:
    """Reverses view[start:stop] in place, half against half."""
    half = (stop - start) // 2
    low, high = view[start:start + half], view[stop - half:stop]
    kept = low.copy()
    low[:] = high[::-1]
    high[:] = kept[::-1]


def rotate(view: np.ndarray, start: int, cut: int, stop: int) -> None:
    """The blocks [start, cut) and [cut, stop) change places."""
    reverse(view, start, cut)
    reverse(view, cut, stop)
    reverse(view, start, stop)


def lay_out(text: memoryview | bytes, first: int, second: int, form: str, sentinels: Sequence[bytes]) -> bytearray:
    """The output for a text whose prefix ends at byte `first` and whose middle ends at byte `second`."""
    p, s, m = sentinels
    buffer = bytearray()
    for part in (p, text[:first], m, text[first:second], s, text[second:]):
        buffer += part
    middle = len(p) + first
    suffix = middle + len(m) + second - first
    view = np.frombuffer(buffer, np.uint8)
    rotate(view, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def read_back(output: bytes, form: str, sentinels: Sequence[bytes]) -> bytes:
    """The text of an output that is psm or spm."""
    p, s, m = sentinels
    buffer = bytearray(output)
    view = np.frombuffer(buffer, np.uint8)
    # Behind the rotation lies prefix, middle, suffix; rotating back takes the block sizes in the other order.
    if form == "psm":
        start, cut = output.index(s), output.index(m)
    else:
        start, cut = 0, output.index(p)
    rotate(view, start, cut, len(buffer))
    del view  # a buffer that is looked at cannot shrink
    first, second = buffer.index(m), buffer.index(s)
    del buffer[second:second + len(s)]
    del buffer[first:first + len(m)]
    del buffer[:len(p)]
    return bytes(buffer)


def _chars(data: np.ndarray) -> int:
    """Code points of a stretch of UTF-8: bytes that continue none."""
    return int(((data & 0xC0) != 0x80).sum())


def _cut(columns: list[int], text: int, first_draw: int, rate: int, spm: int, sentinels: Sequence[bytes], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(text))
            breaks = np.flatnonzero(data == 10) + 1
            low = np.searchsorted(breaks, offsets[:-1], side="right")
            high = np.searchsorted(breaks, offsets[1:], side="right")
            h1, h2, h3, h4 = (batch.column(first_draw + i).to_numpy().tolist() for i in range(4))
            n, forms, prefixes, middles, outputs = [], [], [], [], []
            for i, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                whole = data[start:stop]
                ends = breaks[low[i]:high[i]] - start  # one past each line break
                units = len(ends) + (stop > start and (not len(ends) or int(ends[-1]) < stop - start))
                raw = whole.tobytes()
                n.append(units)
                if not raw or h3[i] % 100 >= rate or any(x in raw for x in sentinels):
                    forms.append("plain"), prefixes.append(None), middles.append(None), outputs.append(raw)
                    continue
                a, b = sorted((h1[i] % (units + 1), h2[i] % (units + 1)))
                first, second = (0 if k == 0 else int(ends[k - 1]) if k <= len(ends) else stop - start for k in (a, b))
                form = "spm" if h4[i] % 100 < spm else "psm"
                forms.append(form)
                prefixes.append(_chars(whole[:first]))
                middles.append(_chars(whole[first:second]))
                outputs.append(lay_out(raw, first, second, form, sentinels))
            made = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()),
                    pa.array([bytes(x) for x in outputs], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=names)

    return run


def _encoded(sentinels: Sequence[str]) -> list[bytes]:
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    marks = [s.encode() for s in sentinels]
    # A sentinel whose end can begin another one would be found at a wrong place of an output.
    for a in marks:
        for b in marks:
            if a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError("no sentinel may hold another one or end as one begins")
    return marks


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """docs with n (lines), form (plain, psm, spm), prefix_chars, middle_chars (code points) and output.

    rate: out of 100 documents, so many are cut; spm: out of 100 cut ones, so many begin with their suffix.
    """
    kept = [c for c in docs.columns if c not in {f.name for f in RESULTS}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *RESULTS])
    drawn = docs.select(*kept, *[d.alias(unused(f"draw_{i}", kept)) for i, d in enumerate(draws(seed))])
    cut = _cut(list(range(len(kept))), kept.index("text"), len(kept), rate, spm, _encoded(sentinels), schema.names)
    return drawn.mapInArrow(cut, schema)


def restore(outputs: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """outputs (form, output) with restored, the text that each output was made from."""
    marks = _encoded(sentinels)
    kept = [c for c in outputs.columns if c != "restored"]
    schema = T.StructType([*(outputs.schema[c] for c in kept), T.StructField("restored", T.StringType())])
    output, form, names = kept.index("output"), kept.index("form"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(output))
            texts = [data[a:b].tobytes() if f == "plain" else read_back(data[a:b].tobytes(), f, marks)
                     for a, b, f in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(form).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(kept))), pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    return outputs.mapInArrow(run, schema)
