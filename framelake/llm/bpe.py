"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each Spark task.

A task takes the distinct words of its batch as rows (word, position, token),
joins neighbouring tokens to the merge table and contracts each word's leftmost
pair of lowest rank, again and again, until no word has a pair left. Ids are
turned back into bytes by an ordered aggregation.

Words of more than LONG bytes are first cut where no token of the vocabulary
stands across the cut, as no merge can then cross it. What is longer still goes
through a second query, which contracts all occurrences of the lowest pair that
don't overlap, and starts anew after a number of rounds, so that neither its
rounds nor its rows grow with the square of the length.

A word of more than two STRETCHes is encoded stretch by stretch. Tokens are the
encoding of a text exactly if each two neighbours are the encoding of their own
bytes: the first merge across a boundary would happen to the two alone as well.
So two encoded stretches may be joined wherever both have a boundary whose two
tokens pass that test.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

#: Tokens that one recursive query starts from, about; bytes of text in a batch; parts of texts whose ids a Python worker keeps.
ROWS, BATCH_BYTES, KEPT_PARTS = 200_000, 4 << 20, 400_000
#: Bytes from which a word counts as long (one byte holds a place in a shorter one); rows of all rounds that the query of long words makes at most.
LONG, LONG_ROWS = 64, 4_000_000
#: Bytes of a longer word that are encoded at a time, and by how much neighbouring stretches overlap at first.
STRETCH, OVERLAP = 1 << 17, 1 << 10

#: Unicode white space, as the splitting pattern's \s means it (fixed values).
_WHITE = r"\x09-\x0D\x20\x85\xA0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

_ENCODE = """
WITH RECURSIVE s AS (
  SELECT word, pos, token, next_token, 0::UTINYINT AS depth FROM tokens
  UNION ALL
  (WITH pairs AS (SELECT s.*, m.rank * 256 + pos AS k FROM s LEFT JOIN merges m ON m.pair = s.token * {size}::BIGINT + s.next_token),
   best AS (SELECT word, (min(k) & 255)::UTINYINT AS place, (min(k) >> 8)::INTEGER AS merged FROM pairs WHERE k IS NOT NULL GROUP BY word)
   SELECT word, (CASE WHEN pos > place THEN pos - 1 ELSE pos END)::UTINYINT,
          CASE WHEN pos = place + 1 THEN merged ELSE token END,
          CASE WHEN pos + 1 = place THEN merged ELSE next_token END, (depth + 1)::UTINYINT
   FROM pairs JOIN best USING (word) WHERE pos <> place))
SELECT word, pos, token FROM s JOIN (SELECT word, max(depth) AS depth FROM s WHERE pos = 0 GROUP BY word) USING (word, depth)
"""
# `before` is the place of the token to the left. Of each two candidates that share a token the left one is taken, and
# what follows a candidate whose merge gives a pair of lower rank than its own waits
_ENCODE_LONG = """
WITH RECURSIVE s AS (
  SELECT word, pos, before, token, next_token, 0 AS depth FROM tokens
  UNION ALL
  (WITH pairs AS (SELECT s.*, m.rank FROM s LEFT JOIN merges m ON m.pair = s.token * {size}::BIGINT + s.next_token WHERE depth < {rounds}),
   low AS (SELECT word, min(rank) AS rank FROM pairs WHERE rank IS NOT NULL GROUP BY word),
   candidates AS (SELECT word, pos, before, rank, lag(pos) OVER w AS last FROM pairs JOIN low USING (word, rank) WINDOW w AS (PARTITION BY word ORDER BY pos)),
   stretches AS (SELECT *, sum((last IS DISTINCT FROM before)::INTEGER) OVER (PARTITION BY word ORDER BY pos) AS stretch FROM candidates),
   apart AS (SELECT word, pos, before, rank FROM stretches QUALIFY row_number() OVER (PARTITION BY word, stretch ORDER BY pos) % 2 = 1),
   placed AS (SELECT *, lag(pos) OVER (PARTITION BY word ORDER BY pos) AS last FROM apart),
   checked AS (
     SELECT c.word, c.pos, c.before, c.rank, coalesce(ml.rank < c.rank, false) OR coalesce(mr.rank < c.rank, false) AS lower
     FROM placed c
     JOIN pairs second ON second.word = c.word AND second.before = c.pos
     LEFT JOIN pairs l ON l.word = c.word AND l.pos = c.before
     LEFT JOIN merges ml ON ml.pair = (CASE WHEN l.before = c.last THEN c.rank ELSE l.token END) * {size}::BIGINT + c.rank
     LEFT JOIN merges mr ON mr.pair = c.rank * {size}::BIGINT + second.next_token),
   chosen AS (SELECT word, pos, before, rank FROM checked QUALIFY NOT coalesce(bool_or(lower) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false))
   SELECT p.word, p.pos, coalesce(mine.before, p.before), coalesce(mine.rank, p.token)::INTEGER, coalesce(right_one.rank, p.next_token)::INTEGER, p.depth + 1
   FROM pairs p JOIN low ON p.word = low.word
   LEFT JOIN chosen mine ON mine.word = p.word AND mine.pos = p.before
   LEFT JOIN chosen right_one ON right_one.word = p.word AND right_one.before = p.pos
   LEFT JOIN chosen gone ON gone.word = p.word AND gone.pos = p.pos
   WHERE gone.word IS NULL))
SELECT word, pos, before, token, next_token, depth FROM s JOIN (SELECT word, max(depth) AS depth FROM s GROUP BY word) USING (word, depth) ORDER BY word, pos
"""
_DECODE = "SELECT word, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (token) GROUP BY word ORDER BY word"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: token in base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}


def _rows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and place in it of each row, for words of `n` rows."""
    return np.repeat(np.arange(len(n), dtype=np.int32), n), (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)


def _groups(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive words with `most` rows together, about."""
    if not len(size):
        return []
    cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // most) > 0) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(size)]))


def _binary(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Runs of `n` values each as a binary array."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int64) * values.itemsize), pa.py_buffer(values)])


def _joined(cells: pa.Array, where: np.ndarray, spans: np.ndarray) -> pa.Array:
    """The cells at `where`, joined in runs of `spans` cells each."""
    t = cells.take(pa.array(where, pa.int64()))
    at = np.frombuffer(t.buffers()[1], dtype=np.int64, count=len(t) + 1, offset=8 * t.offset) if len(t) else np.zeros(1, dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(spans), [None, pa.py_buffer(at[np.concatenate([[0], np.cumsum(spans)])]), t.buffers()[2] or pa.py_buffer(b"")])


class Codec:
    """One tokenizer in one Python worker: its merge table and vocabulary in an in-memory DuckDB, and the ids of parts of texts seen so far."""

    def __init__(self, path: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.size, self.longest = max(self.ranks.values()) + 2, max(map(len, self.ranks))  # the last number stands for the end of a word
        self.heads: dict[bytes, int] = {}  # longest token by its first two bytes
        for t in self.ranks:
            self.heads[t[:2]] = max(self.heads.get(t[:2], 1), len(t))
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.bytes_of = np.zeros(self.size, dtype=np.int64)
        self.bytes_of[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, dtype=np.int32))
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.split = regex.compile(public_tokenizers.PATTERN.replace(r"\S", f"[^{_WHITE}]").replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]"))
        pair, rank = [], []
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    pair.append(a * self.size + b)
                    rank.append(r)
        # bounded by ROWS and LONG_ROWS; nothing goes to a local disk
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        self._table("merges", {"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int64())})
        self._table("vocabulary", {"token": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        self.forget()

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("new_rows", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM new_rows")
        self.db.unregister("new_rows")

    def _run(self, sql: str, name: str, columns: dict) -> dict[str, np.ndarray]:
        self.db.register(name, pa.table(columns))
        rows = {k: np.asarray(v) for k, v in self.db.execute(sql).fetchnumpy().items()}
        self.db.unregister(name)
        return rows

    def _tokens(self, words: list[bytes]) -> dict[str, np.ndarray]:
        word, pos = _rows(np.array([len(w) for w in words]))
        token = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        follows = np.append(word[1:] == word[:-1], False)
        return {"word": word, "pos": pos, "token": token, "next_token": np.where(follows, np.append(token[1:], 0), self.size - 1).astype(np.int32)}

    def _short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokens = self._tokens(words)
        tokens["pos"] = tokens["pos"].astype(np.uint8)
        rows = self._run(_ENCODE.format(size=self.size), "tokens", tokens)
        order = np.argsort(rows["word"].astype(np.int64) * 256 + rows["pos"])
        return rows["token"][order].astype(np.int32), np.bincount(rows["word"], minlength=len(words))

    def _long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokens = self._tokens(words)
        tokens["before"] = tokens["pos"] - 1
        done: list[dict] = []
        while len(tokens["word"]):
            rounds = max(2, min(64, LONG_ROWS // len(tokens["word"])))
            rows = self._run(_ENCODE_LONG.format(size=self.size, rounds=rounds), "tokens", tokens)
            ended = rows["depth"] < rounds
            done.append({k: rows[k][ended] for k in ("word", "pos", "token")})
            tokens = {k: rows[k][~ended] for k in ("word", "pos", "before", "token", "next_token")}
        word, pos, token = (np.concatenate([d[k] for d in done]) for k in ("word", "pos", "token"))
        order = np.lexsort((pos, word))
        return token[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _cuts(self, word: bytes) -> list[bytes]:
        """The word in pieces that no merge can join: no token of the vocabulary stands across a cut."""
        out, begin, reach = [], 0, 0
        for i in range(len(word)):
            if i and i >= reach:
                out.append(word[begin:i])
                begin = i
            longest = min(self.heads.get(word[i : i + 2], 1), len(word) - i)
            reach = max(reach, next((i + n for n in range(longest, 1, -1) if word[i : i + n] in self.ranks), i + 1))
        return [*out, word[begin:]]

    def _merged(self, pieces: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Ids of groups of pieces by the two queries, their numbers, and the places of the pieces. Empty pieces are passed over."""
        flat, counts, order = [], [], []
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        for query, mine in ((self._short, (size > 0) & (size <= LONG)), (self._long, size > LONG)):
            mine = np.flatnonzero(mine)
            for a, b in _groups(size[mine], ROWS):
                ids, n = query([pieces[k] for k in mine[a:b].tolist()])
                flat.append(ids)
                counts.append(n)
                order.append(mine[a:b])
        return flat, counts, order

    def _stretch(self, word: bytes, begin: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a stretch of a word and where each ends in the word."""
        text = word[begin : begin + size]
        if text != self.last[0]:  # long runs of one letter have equal stretches
            pieces = self._cuts(text)
            flat, counts, order = self._merged(pieces)
            at = [None] * len(pieces)
            for ids, n, mine in zip(flat, counts, order):
                for k, cell in zip(mine.tolist(), np.split(ids, np.cumsum(n)[:-1])):
                    at[k] = cell
            self.last = text, np.concatenate(at)
        ids = self.last[1]
        return ids, begin + np.cumsum(self.bytes_of[ids])

    def _stand(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their own bytes."""
        if (a, b) not in self.pairs:
            if len(self.pairs) > KEPT_PARTS:
                self.pairs.clear()
            (ids,), _, _ = self._merged([self.tokens[a] + self.tokens[b]])
            self.pairs[a, b] = ids.tolist() == [a, b]
        return self.pairs[a, b]

    def _stretched(self, word: bytes) -> np.ndarray:
        """Ids of a very long word."""
        done, begin, size, back = [], 0, STRETCH, OVERLAP
        ids, ends = self._stretch(word, begin, size)
        while ends[-1] < len(word):
            k = int(np.searchsorted(ends, ends[-1] - back))
            if back >= size // 2:  # nowhere do two stretches of this size agree
                size, back = 2 * size, OVERLAP
                ids, ends = self._stretch(word, begin, size)
                continue
            after, after_ends = self._stretch(word, int(ends[k]), size)
            starts = np.concatenate([ends[k : k + 1], after_ends[:-1]])
            _, i, j = np.intersect1d(ends[k:], starts, return_indices=True)
            seam = next(((x + k, y) for x, y in zip(i.tolist(), j.tolist()) if self._stand(int(ids[x + k]), int(after[y]))), None)
            if seam is None:
                back *= 2
                continue
            done.append(ids[: seam[0] + 1])
            begin, back = int(ends[seam[0]]), OVERLAP
            ids, ends = after[seam[1] :], after_ends[seam[1] :]
        return np.concatenate([*done, ids])

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and the number of each. A word that is itself a token is that token."""
        pieces, of, single, single_at = [], [], [], []
        flat, counts, order = [], [], []
        for k, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                single.append(whole)
                single_at.append(len(pieces))
                mine = [b""]
            elif len(w) > 2 * STRETCH:
                flat.append(self._stretched(w))
                counts.append(np.array([len(flat[-1])]))
                order.append(np.array([len(pieces)]))
                mine = [b""]
            else:
                mine = [w] if len(w) <= LONG else self._cuts(w)
            pieces += mine
            of += [k] * len(mine)
        flat.append(np.array(single, dtype=np.int32))
        counts.append(np.ones(len(single), dtype=np.int64))
        order.append(np.array(single_at, dtype=np.int64))
        of = np.array(of, dtype=np.int64)
        flat, counts, order = (x + y for x, y in zip((flat, counts, order), self._merged(pieces)))
        by = np.argsort(np.concatenate(order))
        n, flat = np.concatenate(counts), np.concatenate(flat)
        begin, n = (np.cumsum(n) - n)[by], n[by]
        ids = flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(flat))]
        return ids, np.bincount(of, weights=n, minlength=len(words)).astype(np.int64)

    def expand(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Bytes of each sequence of ids; `n` has their lengths."""
        out: list[bytes] = []
        if len(n) and n.max() > ROWS:  # long sequences in parts
            parts = [min(ROWS, int(x) - k) for x in n for k in range(0, max(1, int(x)), ROWS)]
            cells = iter(self.expand(ids, np.array(parts, dtype=np.int64)))
            return [b"".join(next(cells) for _ in range(0, max(1, int(x)), ROWS)) for x in n]
        ends = np.concatenate([[0], np.cumsum(n)])
        for a, b in _groups(n, ROWS):
            word, pos = _rows(n[a:b])
            self.db.register("ids", pa.table({"word": word, "pos": pos, "token": ids[ends[a] : ends[b]]}))
            rows = self.db.execute(_DECODE).fetchall()
            self.db.unregister("ids")
            assert len(rows) == b - a, "a word without ids, or an id outside the vocabulary"
            out += [bytes.fromhex(h) for _, h in rows]
        return out

    def encode_parts(self, parts: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """Ids (as bytes of 32-bit integers) of each part, and what they stand for."""
        data, size = np.frombuffer(b"".join(parts), dtype=np.uint8), np.array([len(p) for p in parts], dtype=np.int64)
        first = np.cumsum(size) - size
        others = np.concatenate([[0], np.cumsum(~_LATIN[data], dtype=np.int32)])
        # a space and Latin letters are one match of the pattern
        latin = others[first + size] == others[first + (data[first] == 0x20)] if len(parts) else np.zeros(0, dtype=bool)
        words: dict[bytes, int] = {}
        where, spans = [], np.ones(len(parts), dtype=np.int64)
        for k, (part, plain) in enumerate(zip(parts, latin.tolist())):
            if plain and part[part[0] == 32 :].decode("utf-8").isalpha():
                where.append(words.setdefault(part, len(words)))
            else:
                mine = self.split.findall(part.decode("utf-8"))
                spans[k] = len(mine)
                where += [words.setdefault(w.encode("utf-8"), len(words)) for w in mine]
        ids, n = self.contract(list(words))
        back = pa.array(self.expand(ids, n), pa.large_binary())
        where = np.array(where, dtype=np.int64)
        return _joined(_binary(ids, n), where, spans), _joined(back, where, spans)

    def look_up(self, raw: bytes, start: np.ndarray, end: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Ids, bytes they stand for, and the place of each of the given parts in those two. `key` is ascending but for parts at the end whose key another part has too."""
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        hit = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), dtype=bool)
        new = np.flatnonzero(~hit)
        cells = self.encode_parts([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])
        ids, back = (pa.concat_arrays([x, y]) for x, y in zip(self.cells, cells))
        slot = np.empty(len(key), dtype=np.int64)
        slot[hit] = at[hit]
        slot[new] = len(self.key) + np.arange(len(new))
        self.times[at[hit]] += 1
        keep = np.ones(len(new), dtype=bool)  # short parts whose key is theirs alone are kept
        keep &= (end - start)[new] <= LONG
        keep[1:] &= key[new][1:] != key[new][:-1]
        if len(self.key):
            keep &= self.key[at[new]] != key[new]
        mine = np.concatenate([np.arange(len(self.key)), len(self.key) + np.flatnonzero(keep)])
        keys, checks, times = np.concatenate([self.key, key[new[keep]]]), np.concatenate([self.check, check[new[keep]]]), np.concatenate([self.times, np.zeros(int(keep.sum()), dtype=np.int32)])
        if len(keys) > KEPT_PARTS:  # the half that was met in fewer batches goes
            stay = np.sort(np.argsort(-times, kind="stable")[: KEPT_PARTS // 2])
            keys, checks, times, mine = keys[stay], checks[stay], times[stay] // 2, mine[stay]
        by = np.argsort(keys, kind="stable")
        self.key, self.check, self.times = keys[by], checks[by], times[by]
        mine = pa.array(mine[by])
        self.cells = (ids.take(mine), back.take(mine))
        return ids, back, slot

    def forget(self) -> None:
        none = pa.array([], pa.large_binary())
        self.key, self.check, self.times = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.cells = (none, none)


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


#: Kinds of ASCII bytes that the pattern parts: letters, digits, other signs but the apostrophe.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[48:58] = 3
_KIND[0x27] = 0
#: Bytes of ASCII and Latin letters up to U+027F.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True


def _parts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of parts that the pattern never matches across.

    Cuts stand before a single space between two bytes that aren't white space,
    and between ASCII letters, digits and other signs. The byte after such a
    space must not open a wider white-space character, as those may belong to
    the same run as the space; and an apostrophe may open a match with the
    letters that follow, so no cut stands beside it.
    """
    wide = K.SPACE.copy()
    wide[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 2:
        cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        cut[1:-2] |= (data[1:-1] == 0x20) & ~K.SPACE[data[:-2]] & ~wide[data[2:]]
    cut[at] = True
    start = np.flatnonzero(cut[:-1])
    end = np.append(start[1:], len(data)) if len(start) else start
    return start, end, np.searchsorted(at, start, side="right") - 1


def _tokenized(texts: pa.Array, codec: Codec) -> tuple[pa.Array, pa.Array]:
    """Ids (as bytes of 32-bit integers) of each whole text (null: empty), and the bytes they stand for."""
    data, at = K.buffer(texts)
    start, end, row = _parts(data, at)
    # equal parts are encoded once; a second hash is compared too, and a part that differs in it goes by itself
    key, first, inverse = np.unique(K.hashes(data, start, end, K.SAME), return_index=True, return_inverse=True)
    second = K.hashes(data, start, end, K.SAME, which=1)
    odd = np.flatnonzero(second != second[first][inverse])
    if len(odd):
        inverse = inverse.copy()
        inverse[odd] = len(first) + np.arange(len(odd))
        key, first = np.append(key, key[np.searchsorted(key, K.hashes(data, start[odd], end[odd], K.SAME))]), np.append(first, odd)
    ids, back, slot = codec.look_up(data.tobytes(), start[first], end[first], key, second[first])
    spans = np.bincount(row, minlength=len(texts))
    return _joined(ids, slot[inverse], spans), _joined(back, slot[inverse], spans)


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an array of their bytes, and the bounds of each cell in them."""
    at = np.frombuffer(ids.buffers()[1], dtype=np.int64, count=len(ids) + 1) // 4
    return np.frombuffer(ids.buffers()[2], dtype=np.int32, count=int(at[-1])), at


def tokenize(texts: pa.Array, codec: Codec) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids of all whole texts (null: empty), one after the other; the number of each; and the bytes that each text's ids stand for."""
    ids, back = _tokenized(texts, codec)
    flat, at = _flat(ids)
    return flat, np.diff(at), back.to_pylist()


def encode_decode(docs: DataFrame, text: str = "text", *, path: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """`docs` plus `ids` (array of int) and `decoded` (binary: what the ids stand for) of each whole text.

    `path` names a rank file that each executor can read. Each match of
    `public_tokenizers.PATTERN` is encoded by itself, without special tokens. A larger `batch_bytes` encodes fewer
    parts twice and holds more memory. Null counts as the
    empty text, which has no ids. Other columns and repeated rows stay; columns
    `ids` and `decoded` of the input give way.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        codec = _codec(path)
        for whole in batches:
            for part in K.batches([whole], rows=65_536, size=batch_bytes):
                ids, back = _tokenized(part.column(text), codec)
                flat, at = _flat(ids)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat)), back.cast(pa.binary())], [*part.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def op9_duckdb_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents: number of ids of the whole text, digest of the ids, digest of the bytes that they decode to. Null counts as empty: no ids, and the digests of nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
