"""BPE encoding by backtracking over longest token matches, decoding by an offset table.

Encoder: an automaton over all tokens gives the longest token at each place of a word. The encoder takes longest matches from the left; a token may follow
another only if the pair is compatible, that is, if no merge would ever have crossed their boundary. If it does not fit, the next shorter token is
tried, then the token before is given up; a place that failed is not entered again. The one sequence that ends this way is the
one that merging gives. Compatibility of a pair is worked out once and kept in a table.

The vocabulary file states how a text becomes words; this module reads files whose texts are normalised (NFC, lower case), split by a pattern
with white space dropped, spelled in byte characters and closed by an end-of-word mark. Anything else is refused.

Defined cases: a null text is empty and gives no tokens; special tokens written in a text become their ids, as in the file; texts of any length are
taken whole, word by word; rows that repeat give equal rows; extra columns pass through.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftgauge.llm.common import flat, steps

#: Words whose ids a worker keeps; when full, the table starts anew. It bounds memory, never the result.
KEPT_WORDS = 800_000
KEPT_PAIRS = 1_000_000
#: Bytes of text that are encoded and spelled at once.
ENCODE_BYTES = 1_000_000
END = "\ue000"


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Words(dict):
    """Ids of a word as int32 bytes, encoded when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        out = self[word] = np.array(self.encode(word), np.int32).tobytes()
        return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]
                or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"] or spec["decoder"] or model["ignore_merges"]):
            raise ValueError(f"{path}: only lower-case BPE with word ends is read here")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        spelled = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for t, i in (model["vocab"] | self.special).items():
            spelled[i] = t
        self.spelled = spelled
        inner = {t[:-len(suffix)] + END if t.endswith(suffix) else t: i for t, i in model["vocab"].items()}
        ident = model["vocab"]
        self.size = {i: len(t) for t, i in inner.items()}
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.formed: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, left part, right part
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = ident[left], ident[right], ident[left + right]
            self.pair_rank[a, b] = rank
            self.formed.setdefault(c, (rank, a, b))
        self.matches = ahocorasick.Automaton()
        for t, i in inner.items():
            self.matches.add_word(t, i)
        self.matches.make_automaton()
        # The longest token that is a proper prefix of each token.
        self.shorter = {i: next((inner[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in inner), None) for t, i in inner.items()}
        self.alphabet = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = _Words(self._word)

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the merges next to the boundary, the latest first: does a merge across it ever come before those that used its parts?"""
        used_a = used_b = len(self.pair_rank)
        while True:
            rank = self.pair_rank.get((a, b))
            if rank is not None and rank < used_a and rank <= used_b:  # of equal merges the left one comes first
                return False
            fa, fb = self.formed.get(a), self.formed.get(b)
            if fa is None and fb is None:
                return True
            if fb is None or fa is not None and fa[0] > fb[0]:
                used_a, a = fa[0], fa[2]
            else:
                used_b, b = fb[0], fb[1]

    def _word(self, word: str) -> list[int]:
        if word.isascii() and word.isprintable():  # these stand for themselves
            text = word + END
        else:
            text = word.encode("utf-8").decode("latin-1").translate(self.alphabet) + END
        n, fits, size = len(text), self.fits, self.size
        longest = [-1] * n
        for end, t in self.matches.iter(text):
            start = end + 1 - size[t]
            if longest[start] < 0 or size[t] > size[longest[start]]:
                longest[start] = t
        open_, out, at = [True] * (n + 1), [], 0
        token: int | None = longest[0]
        while at < n:
            end = at + size[token]
            if open_[end]:
                pair = (out[-1], token) if out else None
                ok = pair is None or fits.get(pair)
                if ok is None:
                    if len(fits) >= KEPT_PAIRS:
                        fits.clear()
                    ok = fits[pair] = self._compatible(*pair)
                if ok and (end == n or longest[end] >= 0):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else None
                    continue
            token = self.shorter[token]
            if token is None:  # nothing fits here: give up the token before
                open_[at] = False
                token = out.pop()
                at -= size[token]
        return out

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # Lower case goes character by character: no special form at the end of a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """Ids as int32 bytes."""
        if self.cut is None or "<" not in text:
            return self._plain(text)
        pieces = self.cut.split(text)
        return b"".join(np.int32(self.special[x]).tobytes() if i % 2 else self._plain(x) for i, x in enumerate(pieces))


class OffsetTable:
    """Texts by id in one buffer, each followed by a space: a sequence of ids is spelled by one gather."""

    def __init__(self, texts: list[str]):
        data = [t.encode("utf-8") + b" " for t in texts]
        self.size = np.array([len(x) for x in data], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in order, and where each id starts."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)
        return self.data[at], np.concatenate([[0], ends]).astype(np.int64)


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Bpe, OffsetTable, OffsetTable]:
    """Once per worker: the encoder, the decoder's table, and a table that spells ids in decimal."""
    bpe = Bpe(path)
    return bpe, OffsetTable(bpe.spelled), OffsetTable([str(i) for i in range(len(bpe.spelled))])


def decode(ids: np.ndarray, path: str) -> str:
    """The tokens of ids, joined by single spaces: the file names no decoder."""
    return codec(path)[1].spell(ids)[0].tobytes()[:-1].decode("utf-8")


ENCODED = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves. No shuffle: each task encodes its own rows."""
    from hashlib import sha256

    added = [*ENCODED, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]
    docs = docs.drop(*[f.name for f in added])
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, tokens, numbers = codec(path)
        for batch in batches:
            _, offsets = flat(batch.column(text_at))
            for i, j in steps(offsets, ENCODE_BYTES):
                part = batch.slice(i, j - i)
                coded = [bpe.encode(x or "") for x in part.column(text_at).to_pylist()]
                counts = np.array([len(x) // 4 for x in coded], np.int64)
                ids, ends = np.frombuffer(b"".join(coded), np.int32), np.concatenate([[0], np.cumsum(counts)])
                digests = []
                for table in (numbers, tokens):
                    data, starts = table.spell(ids)
                    data, at = memoryview(data), starts[ends]
                    digests.append([sha256(data[a:max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])])  # without the last space
                columns = [pa.array(counts), *map(pa.array, digests)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                for field, column in zip(added, columns):
                    part = part.append_column(field.name, column)
                yield part

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
