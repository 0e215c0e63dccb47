"""Greedy seeds of reads by packed numbers: longest matches, frequencies and errors are asked for by slices of reads.

As read_seeding.greedy_seeds() and strand_choice(), but no place and no seed is a row that is sorted or joined: a slice asks for
its distinct windows among all windows of the contigs, walks through its reads, and asks for the distinct seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .packed import KINDS, ROOM, answered, ascii_of, beginnings, blocks, closed, numbered, numbers, opened, padded, slices, spread, unpacked, weighed

#: First bases by which windows meet; what matches no further is told from a table of all such beginnings.
HEAD = 8
#: Letters as digits: N as such, the end of a text (and in reads any other letter) 5.
_END = 5
_CONTIG, _READ = np.full(256, 4, np.uint8), np.full(256, _END, np.uint8)
for _table in (_CONTIG, _READ):
    _table[[ord(c) for c in "ACGTN"]] = range(5)
_COMPLEMENT = np.array([3, 2, 1, 0, 4, 5], np.uint8)


def _windows(contigs: DataFrame, length: int, head: int) -> DataFrame:
    """Rows of KINDS, kind 2: the windows of ``length`` letters at all places, cut short by the contig's end, and how often each occurs."""
    many = blocks(contigs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits, at, _, _ = padded(ascii_of(batch.column("seq")), length, _CONTIG, _END)
            for i in range(0, len(at), ROOM):
                codes, n = weighed(numbered(digits, at[i : i + ROOM], length, 6))
                yield spread(2, codes, codes // 6 ** (length - head), many, 0, n)

    return contigs.select("seq").mapInArrow(run, KINDS)


def _common(codes: np.ndarray, table: np.ndarray, length: int) -> np.ndarray:
    """How many first digits each of ``codes`` shares with some of the sorted ``table``, at most."""
    found = np.zeros(len(codes), np.int64)
    if not len(table):
        return found
    at = np.searchsorted(table, codes)
    for beside in (table[np.maximum(at - 1, 0)], table[np.minimum(at, len(table) - 1)]):
        live = np.arange(len(codes))
        for j in range(1, length + 1):
            power = 6 ** (length - j)
            live = live[codes[live] // power == beside[live] // power]
            if not len(live):
                break
            found[live] = np.maximum(found[live], j)
    return found


def _between(table: np.ndarray, n: np.ndarray, codes: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """How many of the sorted ``table``, ``n`` times each, begin with the first ``size`` digits of ``codes``."""
    upto = np.append(0, np.cumsum(n))
    power = 6 ** (length - size)
    low = codes // power
    return upto[np.searchsorted(table, (low + 1) * power - 1, "right")] - upto[np.searchsorted(table, low * power)]


def _sizes(codes: np.ndarray, length: int) -> np.ndarray:
    """How many digits come before the ends that fill a number up."""
    size, live = np.full(len(codes), length), np.arange(len(codes))
    for j in range(length):
        live = live[codes[live] // 6**j % 6 == _END]
        size[live] = length - 1 - j
    return size


class _Strands:
    """Both strands of a slice's reads one after another: all as they are, then the reverse complements, the last read first."""

    def __init__(self, table: pa.Table, length: int) -> None:
        texts = ascii_of(table.column("seq")) if table.num_rows else pa.array([], pa.string())
        digits, at, _, _ = padded(texts, 0, _READ, _END)
        letters = digits[at]
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.read = np.concatenate([np.arange(len(sizes)), np.arange(len(sizes))[::-1]])
        self.strand = np.repeat([0, 1], len(sizes))
        self.size = np.concatenate([sizes, sizes[::-1]])
        self.end = np.cumsum(self.size)  # of each among the places
        row = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.arange(len(row)) + length * row
        self.digits = np.full(len(row) + length * (len(self.size) + 1), _END, np.uint8)
        self.digits[self.at] = np.concatenate([letters, _COMPLEMENT[letters[::-1]]])
        self.code = numbered(self.digits, self.at, length, 6)
        stop = np.where(self.digits == _END, np.arange(len(self.digits)), len(self.digits))
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        self.known = np.minimum(stop[self.at] - self.at, length)

    def seeds(self, match: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, number in order, first place and end of the seeds from the right, by the longest match of each place."""
        reach = np.maximum.accumulate(np.arange(len(match)) + match) if len(match) else match
        begin = self.end - self.size
        row, cur = np.flatnonzero(self.size), self.end[self.size > 0]
        nth, found = np.zeros(len(self.size), np.int64), []
        while len(row):
            left = np.searchsorted(reach, cur)
            hit = left < cur
            found.append((row[hit], nth[row[hit]], left[hit], cur[hit]))
            nth[row[hit]] += 1
            cur = np.where(hit, left, cur - 1)
            on = cur > begin[row]
            row, cur = row[on], cur[on]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4


def greedy_seeds(reads: DataFrame, contigs: DataFrame, fails: DataFrame, k: int, required: int | None = None) -> DataFrame:
    """As read_seeding.greedy_seeds() for patterns of two units of ``k``, 12 at most; with ``required``, strand_choice() of them.

    ``fails``: (pattern, errors) as of repeats.first_fail_errors() of the repeated patterns of two units of known bases. Reads
    with the same number are kept apart.
    """
    length = 2 * k
    head, many = min(HEAD, length), blocks(contigs.sparkSession)
    short, times = beginnings(contigs, head, _CONTIG, _END)
    number = reads.schema["read_no"].dataType.simpleString()
    first = lambda codes: codes // 6 ** (length - head)

    def matches(held: dict, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return _common(codes, np.unique(numbers(held, 2)), length)

    def walk(table: pa.Table, codes: np.ndarray, told: np.ndarray) -> Iterator[pa.RecordBatch]:
        few = np.flatnonzero(told < head)  # what shares less may share more elsewhere
        told[few] = _common(first(codes[few]), short, head)
        s = _Strands(table, length)
        match = np.minimum(told[np.searchsorted(codes, s.code)], s.known)
        row, nth, left, right = s.seeds(match)
        power = 6 ** (length - (right - left))
        code = (s.code[left] // power + 1) * power - 1  # filled up with ends
        begin = (s.end - s.size)[row]
        out = pa.table({"row": s.read[row], "strand": s.strand[row].astype(np.int8), "nth": nth.astype(np.int32), "beg": (left - begin).astype(np.int32), "len": (right - left).astype(np.int8), "code": code})
        both = pa.table({"reads": [closed(table.select(["read_no"]))], "seeds": [closed(out)]})
        yield pa.RecordBatch.from_arrays([pa.array([closed(both)], pa.binary())], names=["batch"])

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits, at, _, _ = padded(batch.column("pattern"), 0, _READ, _END)
            codes = np.sort(numbered(digits, at[::length], length, 6))
            yield spread(1, codes, first(codes), many)

    def freq(held: dict, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        rows = held.get(2, [])
        table, n = unpacked([r[2] for r in rows]), unpacked([r[3] for r in rows])
        order = np.argsort(table)
        close, size = numbers(held, 1), _sizes(codes, length)
        one = close[np.minimum(np.searchsorted(close, codes), len(close) - 1)] == codes if len(close) else np.zeros(len(codes), bool)
        return 2 * _between(table[order], n[order], codes, size, length) + one

    def seeds_of(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        return opened(table.column("reads")[0].as_py()), opened(table.column("seeds")[0].as_py())

    def asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return weighed(seeds_of(table)[1].column("code").to_numpy())

    def ending(table: pa.Table, codes: np.ndarray, told: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, seeds = seeds_of(table)
        names = names.column("read_no").combine_chunks()
        own, strand, nth, beg, size, code = (seeds.column(c).to_numpy().astype(np.int64) for c in ("row", "strand", "nth", "beg", "len", "code"))
        told = told[np.searchsorted(codes, code)]
        often, ets = told // 2, np.where((size < length) | (told % 2 == 1), 1, 2)
        few = np.flatnonzero(size < head)
        often[few] = _between(short, times, first(code[few]), size[few], head)
        if required is None:
            for i in range(0, len(own), ROOM):
                p = slice(i, i + ROOM)
                rest = [pa.array(x[p].astype(np.int32)) for x in (strand, nth, beg, size)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own[p])), *rest, pa.array(often[p]), pa.array(ets[p].astype(np.int32))], names=["read_no", "strand", "nth", "beg", "len", "freq", "ets"])
            return
        order = np.lexsort((nth, own, strand))
        at = (strand * len(names) + own)[order]
        before = np.append(0, np.cumsum(ets[order]))[:-1]
        lead = np.flatnonzero(np.diff(at, prepend=-1))
        before -= np.repeat(before[lead], np.diff(np.append(lead, len(at))))
        taken = before < required
        total = lambda x: np.bincount(at, x, minlength=2 * len(names)).astype(np.int64).reshape(2, -1)  # noqa: E731  sums stay below 2^53
        both, n, e, f = total(np.ones(len(at))), total(taken), total(taken * ets[order]), total(taken * often[order])
        back = (both[1] <= both[0]).astype(np.int64)
        pick = lambda x: pa.array(x[back, np.arange(len(names))])
        yield pa.RecordBatch.from_arrays([names, pa.array(back.astype(np.int32)), pick(n), pick(e), pick(f)], names=["read_no", "strand", "n_seeds", "ets", "freq"])

    windows = _windows(contigs, length, head)
    walked = answered(slices(reads.select("read_no", "seq")), lambda t: weighed(_Strands(t, length).code), first, [windows], matches, walk, "batch binary")
    kind = f"read_no {number}, strand int, nth int, beg int, len int, freq long, ets int" if required is None else f"read_no {number}, strand int, n_seeds long, ets long, freq long"
    close = fails.filter("errors = 1").select("pattern").mapInArrow(patterns, KINDS)
    parts = written(walked.select(F.monotonically_increasing_id().alias("own"), "batch"))
    return answered(parts, asked, first, [windows, close], freq, ending, kind)
