"""Best-fit packing with exact-complement hashing.

Documents are cut into pieces of at most ``capacity`` tokens. The plan is made from the number of
pieces of each length alone (at most ``capacity`` numbers, whatever the size of the corpus): for each
length, longest first, the gap it leaves is looked up among single lengths, sums of two and sums of
three, and combinations that fill it exactly are consumed as often as all their lengths are
available; what is left goes by best fit, longest first. A plan line places a run of pieces of one length,
so pieces get their place from their rank within their length, which needs no group in one place.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, text_chunks, written
from .tokens import WordTokens, default_tokenizer

CAPACITY = 4096
END_ID = 1
#: Characters of words that a task remembers the ids of.
REMEMBER = 3_000_000


def result_id(id_col: str) -> str:
    return free_name(("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "n", "_part", "_before", "_rank"), id_col)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]) of each row; a null text is empty (one piece: the end id).

    An id column that is called like one of the result's gets an underscore before its name.
    """
    path, name, remember = tokenizer or default_tokenizer(), result_id(id_col), REMEMBER

    def run(batches):
        tokens = WordTokens(path, remember)
        for batch in batches:
            for part in text_chunks(batch, "text"):
                ids, offsets = tokens.of_texts(part.column(1))
                row, piece, start, length, crc, own_ids = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        cut = own[at : at + capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if with_ids:
                            own_ids.append(cut.astype(np.int32))
                arrays = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(own_ids, pa.list_(pa.int32()))] if with_ids else [])], names=[name, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{name}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@dataclass
class Plan:
    """Runs of pieces: the pieces of ``length`` ranked ``first`` to before ``last`` go to sequences from ``sequence`` on, at ``offset``."""

    capacity: int
    lines: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    n_sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def place(self, lengths: list[int], times: int, sequence: int | None = None, offset: int = 0) -> int:
        """Put one piece of each of ``lengths`` side by side, in ``times`` sequences (new ones without ``sequence``)."""
        if sequence is None:
            sequence = self.n_sequences
            self.n_sequences += times
        for length in lengths:
            first = self.used.get(length, 0)
            self.used[length] = first + times
            self.lines.append((length, first, first + times, sequence, offset))
            offset += length
        return sequence


def _exact(count: np.ndarray, length: int, plan: Plan) -> None:
    """Consume combinations of one, two or three lengths that fill the gap beside ``length`` exactly."""
    gap = plan.capacity - length

    def consume(*parts: int) -> None:
        need: dict[int, int] = {length: 1}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        times = min(int(count[p]) // n for p, n in need.items())
        if times > 0:
            for p, n in need.items():
                count[p] -= n * times
            plan.place([length, *parts], times)

    if gap and count[gap]:
        consume(gap)
    half = np.arange((gap + 1) // 2, gap)
    if count[length] and len(half):
        for a in half[(count[half] > 0) & (count[gap - half] > 0)][::-1]:
            consume(int(a), int(gap - a))
            if not count[length]:
                return
    if count[length] and gap >= 3:
        there = np.flatnonzero(count[:gap])
        for a in there[::-1]:
            rest = gap - int(a)
            if not count[length] or 3 * int(a) < gap:
                return
            if not count[a] or rest < 2:
                continue
            b = np.arange((rest + 1) // 2, min(int(a), rest - 1) + 1)
            for x in b[(count[b] > 0) & (count[rest - b] > 0)][::-1]:
                consume(int(a), int(x), rest - int(x))
                if not count[length] or not count[a]:
                    break


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Plan for ``histogram[length]`` pieces of each length from 1 to ``capacity``."""
    plan = Plan(capacity)
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] = n
    if count[capacity]:
        plan.place([capacity], int(count[capacity]))
        count[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        if count[length]:
            _exact(count, length, plan)
    open_runs: dict[int, list[tuple[int, int]]] = {}  # by free tokens: (first sequence, sequences)
    for length in range(capacity - 1, 0, -1):
        left = int(count[length])
        while left:
            free = min((f for f in open_runs if f >= length), default=None)
            if free is None:
                each = capacity // length  # so many fit side by side in a new sequence
                new = max(1, left // each)
                take = min(each, left)
                sequence = plan.place([length] * take, new)
                rest = capacity - take * length
                left -= take * new
            else:
                sequence, n = open_runs[free].pop()
                if not open_runs[free]:
                    del open_runs[free]
                new = min(n, left)
                if n > new:
                    open_runs.setdefault(free, []).append((sequence + new, n - new))
                plan.place([length], new, sequence, capacity - free)
                rest = free - length
                left -= new
            if rest:
                open_runs.setdefault(rest, []).append((sequence, new))
    return plan


def packed(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; sequences are gapless from offset 0 and hold ``capacity`` tokens at most."""
    cut = written(cut.withColumn("_part", F.spark_partition_id()), "pieces")
    counts = written(cut.groupBy("length", "_part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = make_plan(histogram, capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("length", "_part", before.alias("_before")), "starts")
    order = Window.partitionBy("length", "_part").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = cut.join(starts.hint("merge"), ["length", "_part"]).withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1)
    lines = np.array(sorted(plan.lines), dtype=np.int64).reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast(lines)  # its size is bounded by the lengths, not by the pieces
    names = [c for c in cut.columns if c != "_part"]

    def place(batches):
        lines = shared.value
        keys = (lines[:, 0] << 48) + lines[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lines[at, 3] + rank - lines[at, 1]), pa.array(lines[at, 4])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in names)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all rows of ``df``: one row for each piece.

    Null and empty texts are one piece of one token; documents longer than ``capacity`` are cut and packed whole; repeated
    rows and ids are packed once each; pieces of one length are ranked by id, place and content, equal ones as they come;
    other columns do not matter; an id column that is called like one of the result's gets an underscore before its
    name. An empty table gives an empty result.
    """
    return packed(pieces(df, id_col, text_col, tokenizer, capacity, END_ID, with_ids), result_id(id_col), capacity)
