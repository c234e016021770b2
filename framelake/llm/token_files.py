"""Token ids in files of Simple-8b words.

Each 64-bit word holds a 4-bit selector and as many ids as fit at one width.
Ids too large for any width follow an escape word as 64 plain bits. A chunk
(whole documents, at least CHUNK_IDS ids unless it is the last) is cut into
blocks of BLOCK_IDS ids; its header has each block's first word, so that any
block, or all of them at once, can be decoded without the words before it.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import BROADCAST_BYTES, settle

#: Ids in a word and bits of each, by selector (fixed values); selectors 0 and 1 are runs of zeros, 15 here is the escape.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
#: The word that says: the next 64 bits are one id as they stand.
ESCAPE = np.uint64(0xFFFFFFFFFFFFFFFF)

BLOCK_IDS, CHUNK_IDS, END_ID = 4_096, 262_144, 2
_MAGIC = 0x5338_4231


def pack(ids: np.ndarray) -> bytes:
    """A chunk: magic, number of ids, number of blocks, each block's first word (all 64 bits), then the words.

    Every block chooses its words greedily: the selector that takes the most
    ids. The choices of all blocks run in step, one word of each at a time.
    """
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK_IDS)
    top = np.uint64((1 << 60) - 2)  # one more would look like the escape
    # for every place: the selector that takes most of the ids that follow up to the block's end
    stop = np.minimum((np.arange(n) // BLOCK_IDS + 1) * BLOCK_IDS, n)
    choice = np.full(n, 15, dtype=np.int64)
    widest = int(ids.max()).bit_length() if n else 0
    for s in range(14, -1, -1):
        if widest <= WIDTHS[s]:  # all are that narrow
            choice[stop - np.arange(n) >= COUNTS[s]] = s
            continue
        low = np.flatnonzero(ids < np.uint64(1 << int(WIDTHS[s])))
        if not len(low):
            break  # no id is that narrow, so none is narrower
        ends = np.flatnonzero(np.diff(low) > 1)
        last = np.append(low[ends], low[-1]) + 1  # where each stretch of narrow ids ends
        reach = np.repeat(last, np.diff(np.concatenate([[-1], ends, [len(low) - 1]])))
        choice[low[np.minimum(reach, stop[low]) - low >= COUNTS[s]]] = s
    large = ids > top
    take = np.where(large, 1, COUNTS[choice])
    at = np.arange(blocks, dtype=np.int64) * BLOCK_IDS
    last = np.minimum(at + BLOCK_IDS, n)
    starts, owner, live = [], [], np.arange(blocks)
    while len(live):
        starts.append(at[live])
        owner.append(live)
        at[live] += take[at[live]]
        live = live[at[live] < last[live]]
    start = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    start.sort()
    sel, esc = choice[start], large[start]
    # places of the words: an escape takes two
    place = np.cumsum(1 + esc) - (1 + esc)
    words = np.zeros(int(len(start) + esc.sum()), dtype=np.uint64)
    for s in range(16):
        mine = np.flatnonzero((sel == s) & ~esc)
        if len(mine):
            word = np.full(len(mine), s, dtype=np.uint64) << np.uint64(60)
            if WIDTHS[s]:
                for k in range(COUNTS[s]):
                    word |= ids[start[mine] + k] << np.uint64(WIDTHS[s] * k)
            words[place[mine]] = word
    words[place[esc]] = ESCAPE
    words[place[esc] + 1] = ids[start[esc]]
    first = place[np.searchsorted(start, np.arange(blocks, dtype=np.int64) * BLOCK_IDS)] if blocks else np.zeros(0, dtype=np.int64)
    head = np.concatenate([np.array([_MAGIC, n, blocks], dtype=np.uint64), first.astype(np.uint64)])
    return head.tobytes() + words.tobytes()


def unpack(chunk: bytes, block: int | None = None) -> np.ndarray:
    """All ids of a chunk, or those of one block, as unsigned 64-bit integers; each width is decoded in one go."""
    head = np.frombuffer(chunk, dtype=np.uint64, count=3)
    assert head[0] == _MAGIC, "not a chunk"
    n, blocks = int(head[1]), int(head[2])
    first = np.frombuffer(chunk, dtype=np.uint64, count=blocks, offset=24).astype(np.int64)
    words = np.frombuffer(chunk, dtype=np.uint64, offset=24 + 8 * blocks)
    if block is not None:
        words = words[first[block] : first[block + 1] if block + 1 < blocks else len(words)]
        n = min(BLOCK_IDS, n - block * BLOCK_IDS)
    plain = np.zeros(len(words), dtype=bool)
    marks = np.flatnonzero(words == ESCAPE)
    if len(marks):  # an escaped id may look like an escape: of a run of such words every second one is an id
        run = np.cumsum(np.concatenate([[True], np.diff(marks) > 1])) - 1
        begin = marks[np.concatenate([[True], np.diff(marks) > 1])]
        marks = marks[(marks - begin[run]) % 2 == 0]
        plain[marks + 1] = True
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    count[marks] = 0
    count[plain] = 1
    to = np.cumsum(count) - count
    out = np.zeros(n, dtype=np.uint64)
    sel[marks], sel[plain] = -1, -2
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(COUNTS[s]):
                out[to[mine] + k] = (words[mine] >> np.uint64(WIDTHS[s] * k)) & mask
    out[to[plain]] = words[plain]
    return out


#: Words whose ids a Python worker keeps; when there are more it starts anew.
KEPT_WORDS = 1_000_000
#: Words that the library encodes in one call.
JOINED = 4_000

#: Kinds of ASCII bytes that the tokenizer parts: letters, digits, other signs (fixed values). White space is 0.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[48:58] = 3
#: Bytes that keep a word in one part: control signs, the apostrophe, all above ASCII.
_RICH = np.zeros(256, dtype=bool)
_RICH[[*range(0, 9), *range(14, 32), 0x27, *range(0x7F, 256)]] = True


class Words:
    """A tokenizer whose words stand alone (white space is dropped, each word ends in a marked token), and the ids of words seen so far."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 3, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.pieces = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known, self.check = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.begin, self.count, self.flat = (np.zeros(0, dtype=np.int32) for _ in range(3))

    def _encode(self, words: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and the number of each.

        Many words are encoded as one text. The tokens that end a piece tell
        where each word stops, as the pieces of a word can be counted; should
        the counts not agree, each word is encoded by itself.
        """
        flat, counts = [], []
        for a in range(0, len(words), JOINED):
            part = words[a : a + JOINED]
            if plain:  # letters alone: the model takes them as they are
                each = [[t.id for t in self.tok.model.tokenize(w)] for w in part]
                flat.append(np.array([i for x in each for i in x], dtype=np.int64))
                counts.append(np.array([len(x) for x in each], dtype=np.int64))
                continue
            n = np.array([1 if (x := unicodedata.normalize("NFC", w).lower()).isalpha() else len(self.pieces.findall(x)) for w in part], dtype=np.int64)
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == n.sum() and (len(stops) == 0 or stops[-1] == len(ids)):
                upto = np.concatenate([[0], stops])[np.cumsum(n)]
                flat.append(ids)
                counts.append(np.diff(upto, prepend=0))
            else:
                for w in part:
                    one = self.tok.encode(w, add_special_tokens=False).ids
                    flat.append(np.array(one, dtype=np.int64))
                    counts.append(np.array([len(one)], dtype=np.int64))
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *flat]), np.concatenate([none, *counts])

    def _parts(self, texts: pa.Array) -> tuple:
        """Parts of all texts that the tokenizer never joins: bytes, start, end and row of each; and the texts that hold a special token's string."""
        data, at = K.buffer(texts)
        whole = np.zeros(len(texts), dtype=bool)
        raw = data.tobytes()
        for s in self.special:
            spot = raw.find(s)
            while spot >= 0:
                whole[np.searchsorted(at, spot, side="right") - 1] = True
                spot = raw.find(s, spot + 1)
        del raw
        start, end, row = K.words(data, at)
        if not len(start):
            return data, start, end, row, whole
        # bytes that keep a word whole, or keep its letters as they are
        rich = np.zeros(len(start), dtype=bool)
        rich[np.searchsorted(start, np.flatnonzero(_RICH[data]), side="right") - 1] = True
        wide = np.zeros(len(start), dtype=bool)
        wide[np.searchsorted(start, np.flatnonzero(data >= 0x80), side="right") - 1] = True
        folded = K.FOLD[data]
        big = np.flatnonzero(folded != data)
        big = big[wide[np.searchsorted(start, big, side="right") - 1]]
        folded[big] = data[big]
        kind = _KIND[data]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        word = np.searchsorted(start, cut, side="right") - 1
        cut = cut[~rich[word] & (cut > start[word]) & (cut < end[word])]
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
            row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, at)))
        if whole.any():
            keep = ~whole[row]
            start, end, row = start[keep], end[keep], row[keep]
        return folded, start, end, row, whole

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all whole texts (null: empty), one after the other, and the number of each. Distinct parts are encoded once in a worker."""
        data, start, end, row, whole = self._parts(texts)
        out, total = np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        if len(start):
            h = K.hashes(data, start, end, K.SAME)
            by = np.argsort(h)
            begins = np.concatenate([[True], h[by[1:]] != h[by[:-1]]])
            first = by[begins]
            known, inverse = h[first], np.empty(len(h), dtype=np.int64)
            inverse[by] = np.cumsum(begins) - 1
            # equal hashes must also agree on length and bytes, eight at a time; a part that doesn't is encoded by itself
            padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
            eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
            size = end - start
            check, longer, off = K.mix(size.astype(np.uint64)), np.arange(len(h)), 0
            while len(longer):
                bits = np.uint64(8) * np.minimum(size[longer] - off, 8).astype(np.uint64)
                chunk = eight[start[longer] + off] & (np.uint64(2**64 - 1) >> (np.uint64(64) - bits))
                check[longer] = chunk ^ (K.mix(check[longer]) if off else check[longer])
                off += 8
                longer = longer[size[longer] > off]
            odd = np.flatnonzero(check != check[first][inverse])
            if len(self.known) + len(known) > KEPT_WORDS:
                self._forget()
            at = np.searchsorted(self.known, known)
            hit = taken = np.zeros(len(known), dtype=bool)
            if len(self.known):
                near = np.minimum(at, len(self.known) - 1)
                taken = self.known[near] == known
                hit = taken & (self.check[near] == check[first])
            new = np.flatnonzero(~hit)
            raw = data.tobytes()
            spans = list(zip(start[first[new]].tolist(), end[first[new]].tolist()))
            fresh_words = [raw[a:b].decode("utf-8") for a, b in spans]
            plain = np.array([w.isascii() and w.isalpha() for w in fresh_words], dtype=bool)
            new = np.concatenate([new[plain], new[~plain]])
            both = [self._encode([w for w, p in zip(fresh_words, plain.tolist()) if p == kind], kind) for kind in (True, False)]
            flat, count = (np.concatenate([x[i] for x in both]) for i in range(2))
            begin = np.cumsum(count) - count + len(self.flat)
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            slot_begin, slot_count = np.empty(len(known), dtype=np.int64), np.empty(len(known), dtype=np.int64)
            slot_begin[new], slot_count[new] = begin, count
            old = np.flatnonzero(hit)
            slot_begin[old], slot_count[old] = self.begin[at[old]], self.count[at[old]]
            fresh = new[~taken[new]]
            fresh = fresh[np.argsort(fresh)]
            to = np.searchsorted(self.known, known[fresh])
            self.check = np.insert(self.check, to, check[first[fresh]])
            self.begin = np.insert(self.begin, to, slot_begin[fresh].astype(np.int32))
            self.count = np.insert(self.count, to, slot_count[fresh].astype(np.int32))
            self.known = np.insert(self.known, to, known[fresh])
            begin, per = slot_begin[inverse], slot_count[inverse]
            flat = self.flat
            if len(odd):
                more, n = self._encode([raw[a:b].decode("utf-8") for a, b in zip(start[odd].tolist(), end[odd].tolist())])
                begin[odd], per[odd] = np.cumsum(n) - n + len(flat), n
                flat = np.concatenate([flat, more.astype(np.int32)])
            begin -= np.cumsum(per) - per
            out = flat[np.repeat(begin, per) + np.arange(int(per.sum()))]
            total = np.bincount(row, weights=per, minlength=len(texts)).astype(np.int64)
        if whole.any():
            pieces = np.split(out, np.cumsum(total)[:-1])
            for k in np.flatnonzero(whole).tolist():
                pieces[k] = np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=np.int64)
                total[k] = len(pieces[k])
            out = np.concatenate(pieces)
        return out, total


_TOKENIZERS: dict[str, Words] = {}


def word_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """`Words.ids` with one tokenizer for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Words(path)
    return _TOKENIZERS[path].ids(texts)


def write_token_files(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encodes every whole text and writes the ids, in ascending doc_id order, as Simple-8b chunks.

    Returns the written table: one row per chunk with `part` (file, in doc_id
    order), `chunk` (place in the file), `doc_ids`, `lengths` and `payload`.
    Each document is followed by `end_id`. Null texts are empty; a null doc_id
    comes first; rows of equal doc_id follow each other, in the order of a hash
    of their text and then of the text. The table lies in the shared folder and
    stays there.
    """
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = files or max(1, docs.rdd.getNumPartitions())
    # the hash parts rows of one doc_id, or of none, should there be many
    order = ("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text")
    placed = docs.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)
    schema = "part int, chunk int, doc_ids array<long>, lengths array<long>, payload binary"

    def run(batches):
        chunk, held, part_no = 0, [], None

        def flush():
            doc, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            doc = pa.array(doc, pa.int64(), from_pandas=True) if doc.dtype != object else pa.array(doc.tolist(), pa.int64())
            return pa.record_batch([pa.array([part_no], pa.int32()), pa.array([chunk], pa.int32()), one(doc), one(pa.array(n, pa.int64())), pa.array([pack(ids)], pa.binary())], names=["part", "chunk", "doc_ids", "lengths", "payload"])

        size = 0
        for whole in batches:
            for b in K.batches([whole], rows=65_536, size=4 << 20):
                part_no = b.column("part")[0].as_py()
                ids, n = word_ids(b.column("text"), path)
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)  # after each document's own ids
                n = n + 1
                doc = np.array(b.column("doc_id").to_pylist(), dtype=object)
                lo, done = 0, 0
                for hi in [*np.flatnonzero(np.diff((size + np.cumsum(n)) // CHUNK_IDS) > 0) + 2, len(n)]:
                    if hi > lo:
                        k = int(n[lo:hi].sum())
                        held.append((doc[lo:hi], n[lo:hi], ids[done : done + k]))
                        lo, done, size = hi, done + k, size + k
                    if size >= CHUNK_IDS:
                        yield flush()
                        chunk, held, size = chunk + 1, [], 0
        if held:
            yield flush()

    return settle(placed.withColumn("part", F.spark_partition_id()).mapInArrow(run, schema), "token-files")


def read_token_files(table: DataFrame) -> DataFrame:
    """Reads the files back: `doc_id`, `start` (ids of all documents before it), `ids` (packed little-endian unsigned 32-bit) and `n_tokens`.

    Chunks are decoded where they lie. Only totals by chunk are shuffled, to
    give each chunk its first place; they are broadcast where their number
    allows it, and joined otherwise.
    """
    spark = table.sparkSession
    sizes = table.select("part", "chunk", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    per_part = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))  # a row for each file
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n")
    starts = sizes.withColumn("inside", inside).join(before, "part").select("part", "chunk", (F.col("part_start") + F.col("inside")).alias("chunk_start"))
    if table.count() * 16 <= BROADCAST_BYTES // 4:
        starts = F.broadcast(starts)

    def run(batches):
        for b in batches:
            for doc, n, payload, at in zip(b.column("doc_ids"), b.column("lengths"), b.column("payload"), b.column("chunk_start").to_pylist()):
                ids = unpack(payload.as_py()).astype("<u4")
                n = np.asarray(n.values)
                ends = np.cumsum(n)
                cells = [ids[e - k : e].tobytes() for k, e in zip(n, ends)]
                yield pa.record_batch([doc.values, pa.array(at + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(cells, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return table.join(starts, ["part", "chunk"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op5_simple8b(spark, sf_dir: str) -> DataFrame:
    """All documents, read back from the files that were written: place and number of ids, and the CRC of those ids. A null text counts as empty and has the end id alone."""
    table = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_files(table).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
