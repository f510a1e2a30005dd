"""BPE encoding and decoding through a distinct-word table.

Texts are split into words at places where no token of a byte-level vocabulary
can cross: before a single space or newline between two visible characters.

1. Each task keeps its texts as packs: the distinct words of about PACK_BYTES of
   text, and every text as the sequence of their numbers.
2. The packs' words meet by hash buckets, in which the words of the whole corpus are
   distinct; each distinct word is encoded once, and the ids go back to the packs.
3. In each pack the ids are joined back by position: packs are stored in buckets, so
   that only ids move for this join. Decoding joins ids with the id-to-piece table.

What is shuffled are compressed columns of distinct words and their ids,
never a row for a word position. A frequent word is one entry of each pack.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to
the empty text; texts of any length are encoded whole; repeated rows give
repeated results, equal texts equal ones; null ids are kept; an empty table gives an empty
table; columns other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.common import bound_batches, coded, mix, runs, slices, unzipped, written_by, zipped

#: Characters beside which a space or newline is never a word boundary. Wider than any library's white space, which costs nothing but longer words.
_BLANK = r"[\x00-\x20\x7F-\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}]"
_SEPARATORS = ["", " ", "\n"]
#: Bytes of text in a pack, at most about; a longer text is a pack of its own.
PACK_BYTES = 32_000_000


def _flag(words: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False), dtype=bool)


def split(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the words of all texts, the distinct words (each with the separator before it), and the offsets of each text."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    lines = pc.split_pattern(text, "\n")
    line_at = np.asarray(lines.offsets, np.int64)
    parts = pc.split_pattern(lines.flatten(), " ")
    part_at = np.asarray(parts.offsets, np.int64)
    line_at, part_at = line_at - line_at[0], part_at - part_at[0]
    codes, distinct = coded(parts.flatten())
    offsets = part_at[line_at]
    separator = np.ones(len(codes), np.int64)
    separator[part_at[:-1]] = 2
    separator[offsets[:-1]] = 0
    # A separator is a boundary if the pieces on both sides have their visible characters there.
    opens, closes = ~_flag(distinct, f"^{_BLANK}|^$"), ~_flag(distinct, f"{_BLANK}$|^$")
    apart = opens[codes]
    apart[1:] &= closes[codes[:-1]]
    apart[offsets[:-1]] = True
    key = codes * 3 + separator
    if not apart.all():
        first = np.flatnonzero(apart)
        size = np.diff(np.append(first, len(codes)))
        merged = np.flatnonzero(size > 1)
        text_of = distinct.to_pylist() if len(merged) * 20 > len(distinct) else None
        made: dict[str, int] = {}
        key, offsets = key[first], np.searchsorted(first, offsets)
        for g in merged.tolist():
            at = range(first[g], first[g] + size[g])
            pieces = [text_of[codes[i]] for i in at] if text_of else distinct.take(pa.array(codes[at.start : at.stop])).to_pylist()
            word = "".join(x for i, piece in zip(at, pieces, strict=True) for x in (_SEPARATORS[separator[i]], piece))
            key[g] = 3 * len(distinct) + made.setdefault(word, len(made))
        extra = pa.array(list(made), pa.large_string())
    else:
        extra = pa.array([], pa.large_string())
    seen = np.flatnonzero(np.bincount(key, minlength=1))
    plain = seen[seen < 3 * len(distinct)]
    before = pa.array(_SEPARATORS, pa.large_string()).take(pa.array(plain % 3))
    words = pc.binary_join_element_wise(before, distinct.take(pa.array(plain // 3)), pa.scalar("", pa.large_string()))
    words = pa.concat_arrays([words, extra.take(pa.array(seen[len(plain) :] - 3 * len(distinct)))])
    to = np.zeros(len(seen) and seen[-1] + 1, np.int64)
    to[seen] = np.arange(len(seen))
    return to[key], words, offsets


def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces(t) -> pa.Array:
    """The id-to-piece table: the bytes of every id, in order of id."""
    to_byte = byte_of()
    vocab = t.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
    return pa.array(out, pa.large_binary())


def _ends(lens: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lens)))


def _framed(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _parts(data: bytes, n: int) -> list[bytes]:
    at = np.cumsum([8 * n, *np.frombuffer(data, np.int64, n).tolist()])
    return [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _strings(words: pa.Array) -> bytes:
    """A column of strings, compressed."""
    import zstandard

    whole = b"".join(words.cast(pa.large_binary()).to_pylist())
    lens = np.asarray(pc.binary_length(words), np.int64)
    return _framed(zipped(lens), zstandard.ZstdCompressor(level=3).compress(whole))


def _from_strings(data: bytes) -> pa.Array:
    import zstandard

    lens, whole = _parts(data, 2)
    at = _ends(unzipped(lens, np.int64))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(zstandard.ZstdDecompressor().decompress(whole)))


def _buckets_of(words: pa.Array, buckets: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words.to_pylist()), np.uint64, len(words))
    return (mix(h) % np.uint64(buckets)).astype(np.int64)


def _packs(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (pack, bucket, data) with words of a pack, and rows (pack, null, data, ids) with texts as numbers of words."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = f"pack long, bucket int, data binary, ids array<{kind}>"
    names = ["pack", "bucket", "data", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            # One numbering for the pack's words: frequent ones first, which keeps the numbers short, then by bucket and alphabet, which keeps the words short.
            to, words = coded(pa.concat_arrays([h[2] for h in held]))
            cuts = _ends(np.array([len(h[2]) for h in held]))
            sequences = [to[a:b][h[1]] for h, a, b in zip(held, cuts[:-1], cuts[1:], strict=True)]
            counts = sum((np.bincount(s, minlength=len(words)) for s in sequences), np.zeros(len(words), np.int64))
            bucket = _buckets_of(words, buckets)
            by_name = np.empty(len(words), np.int64)
            by_name[np.asarray(pc.sort_indices(words))] = np.arange(len(words))
            order = np.lexsort((by_name, bucket, -counts))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            texts = [_framed(zipped(np.diff(h[3])), zipped(rank[s].astype(np.uint32))) for h, s in zip(held, sequences, strict=True)]
            whole = _framed(np.array([len(texts)], np.int64).tobytes(), _framed(*texts))
            ids = pa.concat_arrays([h[0] for h in held])
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.nulls(1, pa.int32()), pa.array([whole], pa.binary()), ids], names)
            words, bucket = words.take(pa.array(order)), bucket[order]
            by = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[by], return_index=True)
            rows = [_framed(zipped(np.diff(at, prepend=0)), _strings(words.take(pa.array(at)))) for at in np.split(by, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), pack)), pa.array(used, pa.int32()), pa.array(rows, pa.binary()), pa.nulls(len(rows), ids.type)], names)

        for b in slices(batches, 1):
            held.append((b.column(0), *split(b.column(1))))
            size += b.column(1).nbytes
            if size > PACK_BYTES:
                yield from packed()
                held, size, pack = [], 0, pack + 1
        if held:
            yield from packed()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _encoded(words: DataFrame, buckets: int, path: str) -> DataFrame:
    """The words of every pack and bucket with their ids: in a bucket each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for rows in runs(batches, ["bucket"]):
            parts = [_parts(x, 2) for x in rows.column("data").to_pylist()]
            columns = [_from_strings(x[1]) for x in parts]
            at, distinct = coded(pa.concat_arrays(columns))
            ids, lens = [], []
            for i in range(0, len(distinct), 4096):
                got = [e.ids for e in t.encode_batch(distinct.slice(i, 4096).to_pylist(), add_special_tokens=False)]
                lens.append(np.fromiter(map(len, got), np.int64, len(got)))
                ids.append(np.fromiter((x for e in got for x in e), np.int32, int(lens[-1].sum())))
            lens = np.concatenate(lens)
            table = pa.LargeListArray.from_arrays(pa.array(_ends(lens)), pa.array(np.concatenate(ids)))
            cuts = _ends(np.array([len(c) for c in columns]))
            for pack, part, a, b in zip(rows.column("pack").to_pylist(), parts, cuts[:-1], cuts[1:], strict=True):
                own = table.take(pa.array(at[a:b]))
                data = _framed(part[0], zipped(lens[at[a:b]]), zipped(own.flatten().to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.array([data], pa.binary())], ["pack", "data"])

    dealt = words.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "pack", "data").mapInArrow(run, "pack long, data binary")


def _joined_back(docs: DataFrame, path: str, id_col: str, text_col: str, prepare: Callable, columns: str) -> DataFrame:
    """prepare(path) gives a function of a pack's ids by word, which gives a function of (numbers, offsets) of texts: their columns."""
    spark = docs.sparkSession
    bound_batches(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    # As many buckets as packs: then a bucket's words take no more than a pack's.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PACK_BYTES + 1)
    packs = written_by(_packs(docs, buckets, id_col, text_col), "packs", "pack", buckets)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    words = _encoded(packs.where("bucket is not null").select("bucket", "pack", "data"), buckets, path)
    answers = words.groupBy("pack").agg(F.collect_list("data").alias("answers"))  # no more than a pack's words
    rows = packs.where("bucket is null").select("pack", "data", "ids").join(answers.hint("merge"), "pack").select("data", "ids", "answers")
    schema = f"`{id_col}` {kind}, {columns}"
    fields = spark.createDataFrame([], schema).schema.fields
    types, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = prepare(path)
        for data, ids, parts in (row for b in batches for row in zip(*b.columns, strict=True)):
            parts = [_parts(x.as_py(), 3) for x in parts.values]
            at = np.concatenate([np.cumsum(unzipped(x[0], np.int64)) for x in parts])
            lens, flat = (np.concatenate([unzipped(x[i], k) for x in parts]) for i, k in ((1, np.int64), (2, np.int32)))
            table = pa.LargeListArray.from_arrays(pa.array(_ends(lens)), pa.array(flat))
            made = with_ids(table.take(pa.array(np.argsort(at))))
            n, texts = _parts(data.as_py(), 2)
            done = 0
            for text in _parts(texts, int(np.frombuffer(n, np.int64)[0])):
                words, numbers = _parts(text, 2)
                offsets = _ends(unzipped(words, np.int64))
                out = made(unzipped(numbers, np.uint32).astype(np.int64), offsets)
                own = ids.values.slice(done, len(offsets) - 1)
                done += len(own)
                yield pa.RecordBatch.from_arrays([own.cast(types[0]), *(c.cast(t) for c, t in zip(out, types[1:], strict=True))], names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row."""

    def prepare(path: str) -> Callable:
        def of(table: pa.Array) -> Callable:
            lens = np.asarray(pc.list_value_length(table), np.int64)

            def columns(numbers: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
                ends = _ends(lens[numbers])[offsets]
                return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(pa.array(numbers)).flatten())]

            return columns

        return of

    return _joined_back(docs, path, id_col, text_col, prepare, "ids array<int>")


def _joined(offsets: np.ndarray, values: pa.Array) -> list[memoryview]:
    """The values of every row, end to end: slices of one buffer."""
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset + offsets] if len(values) else np.zeros(len(offsets), np.int64)
    data = memoryview(values.buffers()[2] or b"")
    return [data[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _concatenated(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    """_joined() as an array, without a copy."""
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset + offsets] if len(values) else np.zeros(len(offsets), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), values.buffers()[2]])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row; null ids decode to the empty text."""
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(tokenizer(path))
        for b in batches:
            col = pc.fill_null(b.column(1), pa.scalar([], b.column(1).type))
            offsets = np.asarray(col.offsets, dtype=np.int64)
            text = _joined(offsets - offsets[0], table.take(col.flatten()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([str(x, "utf-8", "replace") for x in text], pa.string())], [id_col, "text"])

    kind = dict(encoded.select(id_col).dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encode() and decode(): ids meet their pieces once for each word of a pack."""

    def prepare(path: str) -> Callable:
        piece = pieces(tokenizer(path))
        shown = pa.array([f"{i},".encode() for i in range(len(piece))], pa.large_binary())

        def of(table: pa.Array) -> Callable:
            lens = np.asarray(pc.list_value_length(table), np.int64)
            ids, ends = table.flatten(), _ends(lens)
            as_text, decoded = _concatenated(ends, shown.take(ids)), _concatenated(ends, piece.take(ids))

            def columns(numbers: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
                at = pa.array(numbers)
                return [
                    pa.array(np.diff(_ends(lens[numbers])[offsets])),
                    pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in _joined(offsets, as_text.take(at))], pa.string()),
                    pa.array([hashlib.sha256(str(x, "utf-8", "replace").encode()).hexdigest() for x in _joined(offsets, decoded.take(at))], pa.string()),
                ]

            return columns

        return of

    return _joined_back(docs, path, id_col, text_col, prepare, "n_tokens long, ids_sha256 string, decoded_sha256 string")
