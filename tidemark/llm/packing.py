"""Vector best-fit packing of tokenised documents into sequences.

``tokenised`` turns every text into pieces of at most ``capacity`` tokens; ``pack`` places the
pieces into bins with three capacities (tokens, documents, attention cost). Full pieces fill a
bin alone. The rest are dealt by hash into groups of a bounded expected size, and each group is
packed by decreasing length: every open bin that has room in all three dimensions is scored, and
the best one takes the piece. A group leaves about one part-filled bin, so the loss is about one
bin in thousands, whatever the number of groups.

Without limits of their own, documents and attention cost never bind before the tokens do (a
sequence of 4096 tokens holds at most 4096 documents and costs at most 4096**2); ``max_docs`` and
``max_cost`` make them bind.

Edge cases: null and empty texts have the end id alone; a very long text is cut into pieces, which
go to different groups; ties in length go by the other columns; repeated rows are packed each on
its own; an empty table gives an empty result; extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _words

END_ID = 1
CACHE_WORDS = 150_000
SLICE_BYTES = 2 << 20  # larger slices repeat fewer words
BLOCK_BYTES = 1 << 17  # of words that are hashed at once, as that takes several numbers for each byte
GROUP_PIECES = 20_000
BYTES_PER_TOKEN = 2  # at least, of usual texts; only the number of groups follows from it


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of white-space separated words, as bytes of unsigned 32-bit numbers, remembered in bounded caches.

    The tokenizer drops white space and never merges over it, so a text's ids are those of its
    words in turn; it has no capital letters. Plain Latin words go straight to the model, a comma
    or full stop behind them counts as a word; all others take the whole tokenizer, in batches.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def of_stems(self, stems: list[bytes]) -> list[bytes]:
        """Ids of words of Latin letters, in small letters."""
        known, model = self.stems, self.model
        if len(known) + len(stems) > CACHE_WORDS:
            known.clear()
        out = [known.get(x) for x in stems]
        for i, ids in enumerate(out):
            if ids is None:
                x = stems[i]
                word = x.decode() if x.isascii() else x.decode("latin1").translate(self.letters)
                out[i] = known[x] = array("I", [t.id for t in model.tokenize(word)]).tobytes()
        return out

    def of_words(self, words: list[bytes]) -> list[bytes]:
        known = self.words
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
        new = [x for x in words if x not in known]
        for x, e in zip(new, self.tokenizer.encode_batch([x.decode() for x in new], add_special_tokens=False), strict=True):
            known[x] = array("I", e.ids).tobytes()
        return [known[x] for x in words]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each worker process: tasks that follow each other use its caches."""
    return WordIds(path)


def _ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start:start+length] of every row, one after another."""
    ends = np.cumsum(length)
    at = np.repeat(start - (ends - length), length)
    at += np.arange(len(at))
    return flat[at]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
# UTF-8 of the letters from À to ÿ is the byte C3 and one of these; capitals lie 32 below.
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[[*range(0x80, 0xC0)]] = True
_AFTER_C3[[0x97, 0xB7]] = False
_MARK = np.zeros(256, bool)
_MARK[[ord(","), ord(".")]] = True


def _small(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with Latin letters in small, and which bytes belong to such letters."""
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]
    at = np.flatnonzero(lead) + 1
    letter, small = _LETTER[data] | lead, _SMALL[data]
    letter[at] = True
    small[at] += np.uint8(32) * (data[at] < 0x9F)
    return small, letter


def _block_units(data: np.ndarray, small: np.ndarray, letter: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    mark = _MARK[data[last - 1]] & (last - first > 1)
    stop = last - mark
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=letters[1:])
    plain = letters[stop] - letters[first] == stop - first
    mark &= plain
    stop = np.where(plain, stop, last)
    word = np.repeat(np.arange(len(mark)), 1 + mark)
    second = np.zeros(len(word), bool)
    second[1:] = word[1:] == word[:-1]
    start, end = np.where(second, stop[word], first[word]), np.where(second, last[word], stop[word])
    plain = plain[word] & ~second
    hashes = []
    for seed in (2, 3):
        low, exact = (_words.Ranges.of(_words.codes(seed)[x], _words.WORD_BASE) for x in (small, data))
        hashes.append(_words.mixed(np.where(plain, low.hashes(start, end), exact.hashes(start, end)) + plain, seed))
    return start, end, plain, *hashes, word


def _units(data: np.ndarray, small: np.ndarray, letter: np.ndarray, w: _words.Words) -> tuple[np.ndarray, ...]:
    """Start, end, whether it is of Latin letters, two hashes and word of each unit: a Latin word, the mark behind it, or any other word.

    Hashes do not depend on where a unit lies, so they are worked out block by block.
    """
    parts, a = [], 0
    while a < len(w.start) or not parts:
        begin = int(w.start[a]) if len(w.start) else 0
        b = max(a + 1, int(np.searchsorted(w.end, begin + BLOCK_BYTES, "right")))
        first, last = w.start[a:b] - begin, w.end[a:b] - begin
        block = slice(begin, begin + int(last[-1]) if len(last) else begin)
        start, end, *rest, word = _block_units(data[block], small[block], letter[block], first, last)
        parts.append((start + begin, end + begin, *rest, word + a))
        a = b
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def token_ids(ids_of: WordIds, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts of a slice, each text closed by the end id, and where each text begins."""
    w = _words.words(data, offsets)
    small, letter = _small(data)
    start, end, plain, one, two, word = _units(data, small, letter, w)
    number, kinds = pd.factorize(one)
    first = np.zeros(len(kinds), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    # units with one hash must have one second hash; else each is taken by itself
    if len(number) and (two != two[first[number]]).any():
        number, first = np.arange(len(start)), np.arange(len(start))
    # the end id of each text is one more kind of unit
    count = np.bincount(w.text_index()[word], minlength=len(offsets) - 1) if len(word) else np.zeros(len(offsets) - 1, np.int64)
    s, e, is_plain = start[first], end[first], plain[first]
    del w, letter, start, end, plain, one, two, word
    raw, low = data.tobytes(), small.tobytes()
    found: list[bytes] = [b""] * len(first)
    for at, text, of in ((np.flatnonzero(is_plain), low, ids_of.of_stems), (np.flatnonzero(~is_plain), raw, ids_of.of_words)):
        for i, ids in zip(at.tolist(), of([text[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]), strict=True):
            found[i] = ids
    found.append(array("I", [END_ID]).tobytes())
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), np.uint32)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(number)) + np.repeat(np.arange(len(count)), count)
    order = np.full(len(number) + len(count), len(sizes) - 1)
    order[place] = number
    length = sizes[order]
    ids = _ragged(flat, begin[order], length)
    ends = np.cumsum(length)[np.cumsum(count + 1) - 1] if len(count) else np.zeros(0, np.int64)
    return ids.astype("<u4", copy=False), np.concatenate([[0], ends])


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """One row per piece: the ``keep`` columns, piece, start, length, ids_crc32, and the ids if asked for."""
    fields = [f.name for f in docs.select(*keep).schema]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path)
        for batch in batches:
            for a, b, data, offsets in _words.slices(batch.column("__text"), SLICE_BYTES):
                ids, begin = token_ids(ids_of, data, offsets)
                size = np.diff(begin)
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                at = begin[:-1][row] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(at.tolist(), length.tolist(), strict=True)]
                kept = batch.select(fields).slice(a, b - a).take(pa.array(row))
                cols = [*kept.columns, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = [*fields, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    lists = [np.frombuffer(raw[4 * s : 4 * (s + n)], "<u4").astype(np.int32) for s, n in zip(at.tolist(), length.tolist(), strict=True)]
                    cols, names = [*cols, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"{kinds}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(run, schema)


def best_fit(length: np.ndarray, limits: tuple[float, float, float], rule: str = "dot") -> tuple[np.ndarray, np.ndarray, int]:
    """Vector best-fit of pieces given by decreasing length: bin and offset of each, and the number of bins.

    A piece takes (length, 1, length**2) of the limits (tokens, documents, attention cost). Of the
    bins with room in every dimension ``dot`` takes the one with the largest weighted dot-product
    of demand and fullness, ``norm`` the one whose weighted residual after placing is smallest;
    weights are the share of each capacity that an average piece takes. Ties go to the oldest bin.
    """
    n = len(length)
    need = np.stack([length, np.ones(n), length.astype(float) ** 2], 1) / np.asarray(limits, float)
    weight = need.mean(0) if n else np.ones(3)
    weight = weight / weight.sum()
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room = np.zeros((3, 1024))
    used, number = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    live = total = 0
    smallest = need.min(0) if n else np.zeros(3)
    slack = 1e-12
    for i in range(n):
        take = need[i]
        fits = (room[0, :live] >= take[0] - slack) & (room[1, :live] >= take[1] - slack) & (room[2, :live] >= take[2] - slack)
        at = np.flatnonzero(fits)
        if len(at):
            left = room[:, at] - take[:, None]
            if rule == "dot":
                score = (weight * take) @ (1 - room[:, at])
            else:
                score = -(weight @ (left * left))
            j = at[int(np.argmax(score))]
        else:
            if live == room.shape[1]:
                room = np.concatenate([room, np.zeros_like(room)], 1)
                used, number = np.concatenate([used, used * 0]), np.concatenate([number, number * 0])
            j, live = live, live + 1
            room[:, j], used[j], number[j] = 1.0, 0, total
            total += 1
        bins[i], offset[i] = number[j], used[j]
        room[:, j] -= take
        used[j] += length[i]
        if (room[:, j] < smallest - slack).any():  # closed: nothing fits any more
            live -= 1
            room[:, j], used[j], number[j] = room[:, live], used[live], number[live]
    return bins, offset, total


def pack(pieces: DataFrame, n_groups: int, capacity: int = 4096, max_docs: int | None = None, max_cost: float | None = None, rule: str = "dot") -> DataFrame:
    """Add sequence_id and offset to ``pieces``, in place of such columns; ``n_groups`` groups are packed apart.

    A piece that fills a sequence by its tokens has one of its own. Rows are dealt into groups by
    their content and their place in the input, so that repeated rows part. Sequence ids are the
    group's number times 2**32 plus the bin's; reruns over the same files agree.
    """
    limits = (capacity, max_docs or capacity, max_cost or float(capacity) ** 2)
    pieces = pieces.drop("sequence_id", "offset")
    order = [f.name for f in pieces.schema]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(group: pa.Table) -> pa.Table:
        g = group.column("__group")[0].as_py()
        size = group.column("length").to_numpy()
        keys = [(c, "ascending") for c in order if not pa.types.is_nested(group.schema.field(c).type)]
        group = group.append_column("__less", pa.array(-size)).sort_by([("__less", "ascending"), *keys])
        size = group.column("length").to_numpy()
        full = int((size >= capacity).sum())  # the first, as sizes fall
        bins, offset, _ = best_fit(size[full:], limits, rule)
        bins, offset = np.concatenate([np.arange(full), bins + full]), np.concatenate([np.zeros(full, np.int64), offset])
        return group.select(order).append_column("sequence_id", pa.array(bins + (g << 32))).append_column("offset", pa.array(offset))

    place = F.monotonically_increasing_id()
    key = F.pmod(F.xxhash64(*[F.col(c) for c in order if c != "ids"], place), F.lit(n_groups))
    return pieces.withColumn("__group", key).groupBy("__group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, keep: tuple[str, ...] = ("doc_id",), max_docs: int | None = None, max_cost: float | None = None, rule: str = "dot") -> DataFrame:
    """Tokenise and pack whole ``docs``; pieces are cut so short that one alone keeps ``max_cost``.

    The number of groups follows rows and text, so that long texts do not overfill groups.
    """
    longest = min(capacity, math.isqrt(int(max_cost))) if max_cost else capacity
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, round((n + size / (BYTES_PER_TOKEN * longest)) / GROUP_PIECES))
    return pack(tokenised(docs, tokenizer_path, longest, keep), groups, capacity, max_docs, max_cost, rule)
