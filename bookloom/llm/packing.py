"""Best-fit packing of documents into sequences of a fixed number of tokens.

Pieces of the same length are interchangeable, so the packing is worked out on the counts of
lengths, a table of at most ``capacity`` rows: large pieces (above a third of the capacity) are
matched greedily in pairs, which no third one could join, and smaller pieces go, longest first,
into the tightest gap that holds them. The result is a list of runs (so many pieces of a length
go so often into sequences from a number on), which pieces look up by their rank in their length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .process import limited_batches, once_per_process, slices

CAPACITY = 4096
_KEPT = 200_000  # parts of texts whose ids a process remembers, at most
_CHUNK = 20_000  # rows that are ranked together, about

# Of the tokenizer's pattern, what it comes to on the characters below.
_PLAIN = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \n]+")


class _Remembered(dict):
    """``make`` of each key. Of at most ``_KEPT`` values that are held, the half in use longest ago goes."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.earlier = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= _KEPT // 2:
            self.earlier = dict(self)
            self.clear()
        value = self.earlier.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value


def word_encoder(path: str) -> Callable[[str], bytes]:
    """Token ids of a text as little-endian unsigned 32-bit numbers, equal to the tokenizer's.

    For vocabularies that drop white space: a text's ids are those of its parts between blanks
    and line feeds, one after the other. Texts of plain letters, digits and signs are cut as the
    tokenizer does and given to its model; of other texts, and those that hold a special token, the
    parts that are not plain are given to the tokenizer itself. The ids of words are remembered.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    special = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def packed(ids) -> bytes:
        return np.fromiter(ids, "<u4").tobytes()

    def run(part: str) -> bytes:
        visible = part.encode().decode("latin-1").translate(shown)
        return packed(token.id for token in model.tokenize(visible))

    runs = _Remembered(run)
    odd = _Remembered(lambda unit: packed(tokenizer.encode(unit, add_special_tokens=False).ids))

    def plain(text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(token in text for token in special)

    def of_plain(text: str) -> bytes:
        return b"".join(map(runs.__getitem__, _PARTS.findall(text.lower())))

    def encode(text: str | None) -> bytes:
        if plain(text := text or ""):
            return of_plain(text)
        units = text.replace("\n", " ").split(" ")
        return b"".join(of_plain(unit) if plain(unit) else odd[unit] for unit in units)

    return encode


def cut_documents(
    documents: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): documents as pieces of tokens.

    A document's ids are its tokens and ``end_id``. Only documents of more than ``capacity`` ids
    are cut. A null text counts as empty and gives one piece of one id.
    """

    def cut(batches):
        encode = once_per_process(("word_encoder", tokenizer_path), lambda: word_encoder(tokenizer_path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts = (text for some in slices(batch.column(1)) for text in some)
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                ids = encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4")) if keep_ids else row)
            columns = list(zip(*rows)) or [()] * (5 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            kinds += [pa.list_(pa.int64())] * keep_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, kinds)], names
            )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    chosen = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, schema + (", ids array<bigint>" if keep_ids else ""))


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, count, first sequence, pieces in a sequence, offset of the first)``.

    ``counts`` gives the number of pieces of each length. Work and result depend on the number of
    different lengths, not on the number of pieces.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: [(first sequence, how many)]
    keys: list[int] = []  # of gaps, in order
    sequences = 0

    def free(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if gap not in gaps:
                bisect.insort(keys, gap)
                gaps[gap] = []
            gaps[gap].append((first, many))

    left = {length: n for length, n in counts.items() if n > 0}
    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        longest = large[-1]
        many = left[longest]
        others = large if many > 1 else large[:-1]
        at = bisect.bisect_right(others, capacity - longest) - 1
        partner = others[at] if at >= 0 else None
        pair = 2 if partner == longest else 1
        if partner is not None:
            many = many // 2 if pair == 2 else min(many, left[partner])
        runs.append((longest, many * pair, sequences, pair, 0))
        left[longest] -= many * pair
        gap = capacity - pair * longest
        if partner is not None and pair == 1:
            runs.append((partner, many, sequences, 1, longest))
            left[partner] -= many
            gap -= partner
        free(gap, sequences, many)
        sequences += many
        large = [length for length in large if left[length] > 0]
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(keys, length)
            if at < len(keys):
                gap = keys[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], keys[at]
            else:
                gap, first, many = capacity, sequences, -(-n // (capacity // length))
                sequences += many
            each = gap // length
            full = min(many, n // each)
            if full:
                runs.append((length, full * each, first, each, capacity - gap))
                free(gap - each * length, first, full)
                n -= full * each
            if full < many and 0 < n < each:
                runs.append((length, n, first + full, n, capacity - gap))
                free(gap - n * length, first + full, 1)
                full, n = full + 1, 0
            free(gap, first + full, many - full)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces (``doc_id, piece, length``, staged by the caller).

    Every piece of 1 to ``capacity`` tokens gets a place; sequences are filled from 0 without
    gaps. Pieces are ranked within their length in chunks by a hash, so that a length that most
    pieces share is no group of its own; equal rows may swap places. No pieces give no rows.
    """
    lengths = [tuple(row) for row in pieces.groupBy("length").count().collect()]
    total = sum(n for _, n in lengths)
    runs = plan_runs(dict(lengths), capacity)
    chunks = max(1, -(-total // _CHUNK))
    chunk = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks))
    dealt = pieces.withColumn("_chunk", chunk)
    before = (
        dealt.groupBy("length", "_chunk").count()
        .withColumn("_before", F.sum("count").over(
            Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_chunk", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    place = F.row_number().over(
        Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    )
    ranked = (
        dealt.withColumn("_place", place)
        .join(before, ["length", "_chunk"])
        .withColumn("_rank", F.col("_before") + F.col("_place") - 1)
        .drop("_chunk", "_place", "_before")
    )
    names = [name for name in pieces.columns]
    by_length: dict[int, list] = {}
    for length, *rest in runs:
        by_length.setdefault(length, []).append(rest)
    tables = {length: np.array(rows, np.int64) for length, rows in by_length.items()}
    starts = {length: np.cumsum(t[:, 0]) - t[:, 0] for length, t in tables.items()}

    def seat(batches):
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["_rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    own = int(length[rows[0]])
                    run = np.searchsorted(starts[own], rank[rows], "right") - 1
                    at = rank[rows] - starts[own][run]
                    _, first, each, begin = tables[own][run].T
                    sequence[rows] = first + at // each
                    offset[rows] = begin + at % each * own
            yield pa.RecordBatch.from_arrays(
                [*[batch[name] for name in names], pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "_rank").mapInArrow(
        seat, kinds + ", sequence_id bigint, offset bigint"
    )


def pack_documents(
    documents: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all documents.

    With ``keep_ids`` the pieces carry their ``ids`` too, which a writer of sequences would join
    in the order of ``sequence_id, offset``. A null text counts as empty; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.
    """
    pieces = cut_documents(
        documents, tokenizer_path, end_id, capacity, id_col, text_col, keep_ids
    )
    with limited_batches(documents.sparkSession):
        staged = stage(pieces, "pieces")
    return pack(staged, capacity)
