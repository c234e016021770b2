"""Product codes of vectors, with codebooks by the filtering form of Lloyd's rounds.

Vectors of integers are cut into equal parts. Every partition builds a kd-tree
over its parts, position by position, whose nodes keep bounding boxes, sums and
counts, and writes it. A round sends a codebook's entries down each tree: an
entry that no point of a box can be nearest to is dropped, and where one entry
is left the whole subtree is assigned at once. All arithmetic is in integers,
so results depend on neither partitions nor order.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, discard, settle

#: Rows of a tree; a partition of more builds several, so that memory is bounded.
TREE_ROWS = 8_192
#: Points of a leaf, about.
LEAF = 16
#: Largest integer component: distances of parts of up to 512 components fit in 64 bits.
LIMIT = 1 << 26
#: Nodes whose boxes are compared with all entries at a time.
CHUNK = 4_096


@dataclass
class Tree:
    """A kd-tree for each part position over the same rows, all of one shape: node k has children 2k+1 and 2k+2 and holds the points `start[k]:end[k]` of `order`.

    `points` is (parts, rows, width), sorted by `order`; `low`, `high` and
    `total` are (parts, nodes, width).
    """

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @classmethod
    def build(cls, parts: np.ndarray) -> Tree:
        """Median splits along the widest side of each box, level by level for all positions and nodes together."""
        m, n, width = parts.shape
        order = np.tile(np.arange(n), (m, 1))
        start, end = np.array([0]), np.array([n])
        starts, ends, boxes = [], [], []
        at = np.arange(m)[:, None]
        while True:
            points = parts[at, order].astype(np.int64)
            low, high, total = (f.reduceat(points, start, axis=1) for f in (np.minimum, np.maximum, np.add))
            starts.append(start), ends.append(end), boxes.append((low, high, total))
            if (end - start).max() <= LEAF:
                break
            axis = np.repeat((high - low).argmax(axis=2), end - start, axis=1)
            node = np.repeat(np.arange(len(start)), end - start)
            value = np.take_along_axis(points, axis[:, :, None], axis=2)[:, :, 0]
            by = np.argsort(value, axis=1, kind="stable")  # by coordinate, then by node: sorted within nodes
            by = np.take_along_axis(by, np.argsort(node[by], axis=1, kind="stable"), axis=1)
            order = np.take_along_axis(order, by, axis=1)
            middle = (start + end) // 2
            start, end = np.stack([start, middle], 1).ravel(), np.stack([middle, end], 1).ravel()
        low, high, total = (np.concatenate(x, axis=1) for x in zip(*boxes))
        return cls(parts[at, order], order, np.concatenate(starts), np.concatenate(ends), low, high, total)

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of `books` (parts, entries, width) for every point, ties to the lower index.

        Returns entries (parts, rows) in the points' order, counts (parts,
        entries), sums (parts, entries, width) and the number of distances
        measured from points, which the boxes keep low.
        """
        m, k, width = books.shape
        n, nodes = self.points.shape[1], len(self.start)
        first_leaf = nodes // 2
        found = np.zeros((m, n), dtype=np.int64)
        count, total = np.zeros((m, k), dtype=np.int64), np.zeros((m, k, width), dtype=np.int64)
        measured = 0
        for p in range(m):
            book = books[p]
            node, alive = np.array([0]), np.ones((1, k), dtype=bool)
            while len(node):
                kept = [self._filter(p, node[i : i + CHUNK], alive[i : i + CHUNK], book) for i in range(0, len(node), CHUNK)]
                alive = np.concatenate(kept)
                one = alive.sum(axis=1) == 1
                # whole subtrees by their cached sums
                whole, entry = node[one], alive[one].argmax(axis=1)
                size = self.end[whole] - self.start[whole]
                np.add.at(count[p], entry, size)
                np.add.at(total[p], entry, self.total[p, whole])
                found[p, _ranges(self.start[whole], size)] = np.repeat(entry, size)
                leaf = ~one & (node >= first_leaf)
                if leaf.any():
                    size = self.end[node[leaf]] - self.start[node[leaf]]
                    place, mask = _ranges(self.start[node[leaf]], size), np.repeat(alive[leaf], size, axis=0)
                    row, entry = np.nonzero(mask)
                    point = self.points[p, place].astype(np.int64)
                    far = np.full(mask.shape, np.iinfo(np.int64).max)
                    far[row, entry] = ((point[row] - book[entry]) ** 2).sum(axis=1)
                    measured += len(row)
                    best = far.argmin(axis=1)
                    found[p, place] = best
                    np.add.at(count[p], best, 1)
                    np.add.at(total[p], best, point)
                inner = ~one & (node < first_leaf)
                node = np.stack([2 * node[inner] + 1, 2 * node[inner] + 2], 1).ravel()
                alive = np.repeat(alive[inner], 2, axis=0)
        return found, count, total, measured

    def _filter(self, p: int, node: np.ndarray, alive: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Which entries may still be nearest to a point of each node's box."""
        low, high = self.low[p, node], self.high[p, node]
        middle = low + high
        far = ((middle[:, None, :] - 2 * book[None]) ** 2).sum(axis=2)
        best = np.where(alive, far, np.iinfo(np.int64).max).argmin(axis=1)
        star = book[best][:, None, :]
        # the corner of the box that lies most towards an entry: if the best one is as near even there, the entry is nearest nowhere
        corner = np.where(book[None] > star, high[:, None, :], low[:, None, :])
        his, own = ((corner - star) ** 2).sum(axis=2), ((corner - book[None]) ** 2).sum(axis=2)
        index = np.arange(len(book))[None]
        gone = (own > his) | ((own == his) & (index > best[:, None]))
        gone[np.arange(len(node)), best] = False
        return alive & ~gone

    #: Field names and types of a tree at rest.
    FIELDS = (("points", np.int32), ("order", np.int32), ("start", np.int32), ("end", np.int32), ("low", np.int32), ("high", np.int32), ("total", np.int64))

    def pack(self) -> list[bytes]:
        return [getattr(self, f).astype(t).tobytes() for f, t in self.FIELDS]

    @classmethod
    def unpack(cls, cells: list[bytes], m: int, width: int) -> Tree:
        shapes = ((m, -1, width), (m, -1), (-1,), (-1,), (m, -1, width), (m, -1, width), (m, -1, width))
        return cls(*(np.frombuffer(c, dtype=t).astype(t if f == "points" else np.int64).reshape(s) for c, (f, t), s in zip(cells, cls.FIELDS, shapes)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges start .. start + size, one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def integer_vectors(df: DataFrame, vector: str = "embedding", *, scale: int = 256) -> DataFrame:
    """`df` with `ints`, floor(scale * x) of each component; rows whose vector is null or empty or holds a null, a NaN or an infinity go."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter((F.size(v) > 0) & ~bad).withColumn("ints", F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def _trees(parts: int, width: int, names: list[str]):
    """Arrow batches of (names, ints) to rows that hold a tree and the other columns of its vectors."""

    def rows(pending):
        table = pa.Table.from_batches(pending).combine_chunks()
        for at in range(0, table.num_rows, TREE_ROWS):
            some = table.slice(at, TREE_ROWS)
            size = pa.compute.list_value_length(some["ints"]).to_numpy()
            if (size != parts * width).any():
                raise ValueError(f"vectors need one length, {parts * width} here")
            flat = pa.compute.list_flatten(some["ints"]).to_numpy()
            if len(flat) and max(flat.max(), -flat.min()) > LIMIT:
                raise ValueError(f"a component is beyond {LIMIT} after scaling")
            cut = flat.reshape(len(size), parts, width).transpose(1, 0, 2).astype(np.int32)
            tree = Tree.build(np.ascontiguousarray(cut))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.select(names).schema) as out:
                out.write_table(some.select(names))
            yield pa.record_batch([pa.array([x], pa.binary()) for x in (*tree.pack(), sink.getvalue().to_pybytes())], names=[*(f for f, _ in Tree.FIELDS), "others"])

    def run(batches):
        pending, n = [], 0
        for b in batches:
            if b.num_rows:
                pending.append(b)
                n += b.num_rows
            if n >= TREE_ROWS:
                yield from rows(pending)
                pending, n = [], 0
        if pending:
            yield from rows(pending)

    return run


def _opened(batches, parts: int, width: int):
    for b in batches:
        for row in b.to_pylist():
            yield Tree.unpack([row[f] for f, _ in Tree.FIELDS], parts, width), row["others"]


def product_codes(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors of `df` and the codebooks (parts, entries, width).

    The frame has `key`, the columns of `keep`, `code` (two hex digits for each
    part) and `error` (squared distances to the entries, summed). Vectors that
    are null or empty or hold nulls or non-finite components are left out. Codebooks
    start as the parts of the `entries` smallest keys (rows of one key by their
    components, null keys last), fewer if there are fewer rows; entries without
    parts stay. Vectors of several lengths, or of one that `parts` doesn't
    divide, and components beyond LIMIT are errors. An empty table gives an empty one and codebooks
    without entries. Only codebooks, their sums and the first rows reach the driver:
    all bounded by `parts`, `entries` and the length of a vector.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hex digits a part")
    spark = df.sparkSession
    names = [key, *keep]
    ints = integer_vectors(df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*names, vector]))), vector, scale=scale).select(*(F.col(f"`{c}`") for c in names), "ints")
    first = ints.select(F.col(f"`{key}`").alias("key"), "ints").orderBy(F.col("key").asc_nulls_last(), "ints").limit(entries).collect()
    if len({len(r["ints"]) for r in first}) > 1 or (first and len(first[0]["ints"]) % parts):
        raise ValueError(f"vectors need one length, a multiple of {parts}")
    width = len(first[0]["ints"]) // parts if first else 0
    books = np.array([r["ints"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    schema = T.StructType([T.StructField(f, T.BinaryType()) for f in (*(f for f, _ in Tree.FIELDS), "others")])
    trees = settle(ints.mapInArrow(_trees(parts, width, names), schema), "vector-trees")
    for _ in range(rounds if first else 0):
        cell = spark.sparkContext.broadcast(books)  # parts x entries x width

        def sums(batches, cell=cell):
            count, total = np.zeros(cell.value.shape[:2], dtype=np.int64), np.zeros(cell.value.shape, dtype=np.int64)
            for tree, _ in _opened(batches, parts, width):
                _, c, t, _ = tree.assign(cell.value)
                count, total = count + c, total + t
            part, entry = np.nonzero(count)
            yield pa.record_batch([pa.array(part, pa.int64()), pa.array(entry, pa.int64()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

        partial = trees.mapInArrow(sums, "part long, entry long, n long, sums array<long>")
        wide = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
        books = books.copy()
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # parts x entries rows at most
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        cell.unpersist()
    cell = spark.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def codes(batches):
        for tree, others in _opened(batches, parts, width):
            found, _, _, _ = tree.assign(cell.value)
            entry, error = np.empty_like(found), np.zeros(found.shape[1], dtype=np.int64)
            for p in range(parts):
                entry[p, tree.order[p]] = found[p]
                error[tree.order[p]] += ((tree.points[p] - cell.value[p, found[p]]) ** 2).sum(axis=1)
            code = digits[entry].T.copy().view(f"<U{2 * parts}")[:, 0] if entry.size else []
            table = pa.ipc.open_stream(others).read_all().append_column("code", pa.array(code, pa.string())).append_column("error", pa.array(error))
            yield from table.combine_chunks().to_batches()

    out = T.StructType([*(ints.schema[c] for c in names), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = settle(trees.mapInArrow(codes, out), "codes")
    discard(spark, trees)
    return coded, books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the integers of all entries, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """`coded` plus `label_error`, the error summed over rows of an equal label; null labels count together.

    Sums are made before the shuffle; they are broadcast if they are proven
    small, else a sort-merge join stands alone in its stage, so that the
    adaptive skew join can split a hot label.
    """
    total = settle(coded.groupBy(F.col(label).alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    if total.count() * 64 <= BROADCAST_BYTES and not isinstance(total.schema["of"].dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        total = F.broadcast(total)
    return coded.join(total, F.col(label).eqNullSafe(F.col("of")), "left").drop("of")


def op12_filtering_lloyd(spark, sf_dir: str) -> DataFrame:
    """Codes, errors and codebooks of all `embeddings`: 16 parts, 64 entries, 2 rounds."""
    coded, books = product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=("label",))
    out = with_label_error(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of one round: assign by the books of round k, then floor(sum / count)."""
    return f"""
far{k} AS (SELECT v.rid, v.part, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM parts v JOIN books{k} b USING (part)),
near{k} AS (SELECT rid, part, arg_min(entry, {{'d': d, 'e': entry}}) AS entry, min(d) AS d FROM far{k} GROUP BY ALL),
"""


def _moved(k: int) -> str:
    return f"""
sums{k} AS (SELECT part, entry, list(s ORDER BY i) AS x FROM (
  SELECT n.part, n.entry, u.i, (sum(v.x[u.i]) - ((sum(v.x[u.i]) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS s
  FROM near{k} n JOIN parts v USING (rid, part), unnest(range(1, 5)) AS u(i) GROUP BY ALL) GROUP BY ALL),
books{k + 1} AS (SELECT b.part, b.entry, coalesce(s.x, b.x) AS x FROM books{k} b LEFT JOIN sums{k} s USING (part, entry)),
"""


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id) AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
parts AS (SELECT rid, part, x[part * 4 + 1 : part * 4 + 4] AS x FROM kept, unnest(range(16)) AS u(part)),
books0 AS (SELECT part, rid - 1 AS entry, x FROM parts WHERE rid <= 64),
{_round(0)}{_moved(0)}{_round(1)}{_moved(1)}{_round(2)}
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2),
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), digest
"""
