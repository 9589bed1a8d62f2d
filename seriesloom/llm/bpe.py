"""Operator 4: byte-level byte-pair encoding and decoding by recursive queries.

Spark splits each text into pieces by the vocabulary's pattern. A task takes the distinct pieces of
a few MB of text and encodes them in an in-process DuckDB: rows of (piece, position, token) join
the merge table; each step of a recursive query contracts every piece's leftmost pair of
the smallest rank, until no pair is left. Ordered aggregation gives the ids of a piece, and, over the
ids joined with the vocabulary, its decoded bytes. A document is the sequence of its pieces.

The merge table holds every split of every token into two tokens, since a pair's rank is that of
the bytes it makes. A piece that is a token itself is that token. The vocabulary has a fixed size; a
task holds ``CHUNK_BYTES`` of text (or one longer text) and recurses over ``PIECES`` pieces at a time,
so memory does not grow with the partition. A worker process keeps the ids of up to ``KEPT_PIECES`` pieces
that it has encoded (of at most ``KEPT_BYTES`` bytes each) and recurses over the others alone; what it
keeps changes no result.

Defined results: a null or empty text has no ids; both hashes are those of the empty string.
Repeated rows each get their row; other columns are not read. One very long piece takes as many
steps as it has merges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import whole_text

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHUNK_BYTES = 16 << 20
PIECES = 50_000
KEPT_PIECES = 200_000
KEPT_BYTES = 32

# k is the rank of the pair that starts at a row, with the position in its low bits, so the
# smallest k of a piece is its leftmost pair of smallest rank. A piece without a pair is written
# once more as done and leaves the recursion.
ENCODE = """
WITH RECURSIVE steps AS (
  SELECT piece, pos, token, false AS done FROM bytes
  UNION ALL
  SELECT piece, pos, CASE WHEN k = best THEN made ELSE token END, best IS NULL
  FROM (
    SELECT *, min(k) OVER (PARTITION BY piece) AS best,
      lag(k) OVER (PARTITION BY piece ORDER BY pos) AS before
    FROM (
      SELECT s.piece, s.pos, s.token, m.made, (m.made::BIGINT << 32) | s.pos AS k
      FROM (
        SELECT piece, pos, token, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS follower
        FROM steps WHERE NOT done
      ) s LEFT JOIN merges m ON m.head = s.token AND m.tail = s.follower
    )
  )
  WHERE best IS NULL OR before IS DISTINCT FROM best
)
SELECT piece, pos, token FROM steps WHERE done
"""

IDS = "SELECT piece, list(token ORDER BY pos) AS ids FROM tokens GROUP BY piece ORDER BY piece"

DECODE = """
SELECT piece, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS bytes
FROM tokens t JOIN vocabulary v ON v.token = t.token
GROUP BY piece ORDER BY piece
"""


@lru_cache(maxsize=1)
def _database(path: str) -> tuple[duckdb.DuckDBPyConnection, dict[bytes, int], np.ndarray]:
    """Connection with merge table and vocabulary, the ranks, and the token of each byte."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    head, tail, made = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                head.append(a)
                tail.append(b)
                made.append(rank)
    connection = duckdb.connect(config={"threads": 1})
    numbers = [pa.array(x, pa.int32()) for x in (head, tail, made)]
    given = pa.Table.from_arrays(numbers, ["head", "tail", "made"])
    connection.register("given", given)
    connection.execute("CREATE TABLE merges AS SELECT * FROM given")
    connection.unregister("given")
    words = pa.table(
        {
            "token": pa.array(list(ranks.values()), pa.int32()),
            "hex": pa.array([t.hex() for t in ranks], pa.string()),
        }
    )
    connection.register("given", words)
    connection.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
    connection.unregister("given")
    return connection, ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int32)


@lru_cache(maxsize=1)
def _kept(path: str) -> dict[bytes, bytes]:
    """Ids, as 32-bit integers, of pieces that this process has encoded."""
    return {}


def _flat(column: pa.ChunkedArray | pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values, end to end, of a column of lists or of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(kind):
        lengths = np.asarray(column.value_lengths())
        return lengths.astype(np.int64), np.asarray(column.flatten())
    parts = column.to_pylist()
    return np.array([len(p) for p in parts], np.int64), np.frombuffer(b"".join(parts), np.uint8)


def encode_pieces(
    pieces: list[bytes], path: str = VOCABULARY
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For distinct pieces: ids per piece, all ids, decoded bytes per piece, all decoded bytes."""
    connection, ranks, of_byte = _database(path)
    kept = _kept(path)
    n_ids, ids, n_bytes, decoded = [], [], [], []
    for lo in range(0, len(pieces), PIECES):
        group = pieces[lo : lo + PIECES]
        known = [
            b"" if r is None else r.to_bytes(4, "little") for r in map(ranks.get, group)
        ]
        known = [k or kept.get(p, b"") for k, p in zip(known, group)]
        long = np.array([i for i, k in enumerate(known) if not k], np.int64)
        sizes = np.array([len(group[i]) for i in long], np.int64)
        data = np.frombuffer(b"".join(group[i] for i in long), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = pa.table(
            {
                "piece": pa.array(np.repeat(long, sizes).astype(np.int32)),
                "pos": pa.array(place.astype(np.int32)),
                "token": pa.array(of_byte[data]),
            }
        )
        n_known = np.array([len(k) // 4 for k in known], np.int64)
        given = np.arange(n_known.sum()) - np.repeat(np.cumsum(n_known) - n_known, n_known)
        single = pa.table(
            {
                "piece": pa.array(np.repeat(np.arange(len(group)), n_known).astype(np.int32)),
                "pos": pa.array(given.astype(np.int32)),
                "token": pa.array(np.frombuffer(b"".join(known), np.int32)),
            }
        )
        connection.register("bytes", rows)
        connection.register("single", single)
        connection.execute(
            f"CREATE OR REPLACE TEMP TABLE tokens AS SELECT * FROM single UNION ALL ({ENCODE})"
        )
        lengths, values = _flat(connection.sql(IDS).to_arrow_table()["ids"], pa.list_(pa.int32()))
        n_ids.append(lengths)
        ids.append(values)
        ends, raw = np.cumsum(lengths) * 4, values.astype("<i4").tobytes()
        for i in long[: max(0, KEPT_PIECES - len(kept))].tolist():
            if len(group[i]) <= KEPT_BYTES:
                kept[group[i]] = raw[ends[i] - 4 * lengths[i] : ends[i]]
        lengths, values = _flat(connection.sql(DECODE).to_arrow_table()["bytes"], pa.binary())
        n_bytes.append(lengths)
        decoded.append(values)
        connection.unregister("bytes")
        connection.unregister("single")
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return join(n_ids, np.int64), join(ids, np.int32), join(n_bytes, np.int64), join(decoded, np.uint8)


def _gather(codes: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code's span end to end, and where each code's part ends."""
    starts = np.cumsum(sizes) - sizes
    own = sizes[codes]
    ends = np.cumsum(own)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - own), own)
    return values[at], ends


def _documents(batches: list[pa.RecordBatch], path: str) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    lists = table["pieces"].combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = np.asarray(coded.indices)
    words = [w.encode("utf-8") for w in coded.dictionary.to_pylist()]
    n_ids, ids, n_bytes, decoded = encode_pieces(words, path)
    all_ids, id_ends = _gather(codes, n_ids, ids)
    all_bytes, byte_ends = _gather(codes, n_bytes, decoded)
    last = np.cumsum(sizes)
    id_edges = np.concatenate([[0], id_ends])[np.concatenate([[0], last])]
    byte_edges = np.concatenate([[0], byte_ends])[np.concatenate([[0], last])]
    raw, plain = all_ids.astype("<u4"), all_bytes
    return pa.RecordBatch.from_arrays(
        [
            table["doc_id"].combine_chunks(),
            pa.array(np.diff(id_edges)),
            pa.array(
                [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(id_edges[:-1], id_edges[1:])],
                pa.string(),
            ),
            pa.array(
                [hashlib.sha256(plain[a:b].tobytes()).hexdigest() for a, b in zip(byte_edges[:-1], byte_edges[1:])],
                pa.string(),
            ),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows in groups of about ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, 4 * batch.nbytes))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, min(step, batch.num_rows - at))
            held.append(part)
            total += part.nbytes
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and of decoded bytes of every whole text."""
    pieces = docs.select(
        "doc_id", F.regexp_extract_all(whole_text(), F.lit(f"(?U){pattern}"), F.lit(0)).alias("pieces")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _chunks(batches, 2 * CHUNK_BYTES):
            yield _documents(group, path)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return pieces.mapInArrow(
        run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
