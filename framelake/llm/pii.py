"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, and the same wherever the same entity occurs.

A surrogate is a keyed permutation of the entity within its own format: digits
become digits, letters letters of the same script and case (vowels stay
vowels), addresses stay addresses, card numbers keep a valid check digit, known
given names become given names of the same gender and script. So two entities
can't meet in one surrogate by construction; a job over all distinct entities
checks that none meets another entity that occurs in the texts either, and
moves those that do one step on. After a few steps the format counts as full
and the surrogate gets longer by a keyed character a step, so that the check
comes to an end.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from functools import lru_cache
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import BROADCAST_BYTES, private_name, settle

#: What is looked for, in order of precedence where two overlap.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![0-9A-Za-z])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip6": r"(?<![\w:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:.]{0,40}(?!\w)",  # checked by `detect`
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<![\d\-+])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]?\d{3,4}|\+\d{9,15}|\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]\d{1,4}){1,6}|0\d(?:[ .\-]\d\d){4})(?![\w\-])",
    "name": r"(?<=\b(?:Mr|Ms|Dr|Sr|Hr)\. )(?:[^\W\d_]+[ ]?){1,3}|(?<=\b(?:Mrs|Sra|Fra)\. )(?:[^\W\d_]+[ ]?){1,3}|(?<=\b(?:Herr|Frau|Mme\.) )(?:[^\W\d_]+[ ]?){1,3}",
}
#: Types whose digits and letters count only.
_BARE = {"phone", "card", "iban"}
_FIND, _OTHERS = (re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items() if k != without)) for without in ("", "ip6"))

#: Given names by script and gender; a known one is replaced within its own list.
GIVEN = {
    "latin_f": "Anna Maria Emma Laura Julia Sarah Clara Elena Lucia Sofia Alice Marie Carmen Ingrid Helga Claire".split(),
    "latin_m": "John Peter Paul James Thomas David Robert Michael Hans Karl Pierre Jean Carlos Juan Miguel Louis".split(),
    "cyrillic_f": "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна".split(),
    "cyrillic_m": "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил".split(),
}
_LIST_OF = {n.lower(): (k, i) for k, v in GIVEN.items() for i, n in enumerate(v)}

#: Letters that take each other's place: vowels and consonants of each script, by case (fixed values).
_CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "äöü", "éèêëáàâíîïóôúûù", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "0123456789"]
_CLASS_OF = {c: k for k in _CLASSES for c in k}
_HEX = {"0123456789abcdef": set("0123456789abcdef"), "0123456789ABCDEF": set("0123456789ABCDEF")}


#: Address blocks of their own kind (private, shared, loopback, link-local, multicast and such): a surrogate stays in its block (fixed values).
_BLOCKS = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4", "fc00::/7", "fe80::/10", "ff00::/8")]

#: From this attempt on a format counts as full and its surrogates get longer, by one character each time.
FULL = 4


def permute(x: int, n: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(n): a Feistel network over the next even number of bits, walked until it is back inside."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, half // 8 + 1
    while True:
        left, right = x >> half, x & mask
        for r in range(6):
            f = hmac.new(key, tweak + bytes([r]) + right.to_bytes(size, "big"), hashlib.sha256).digest()
            while len(f) < size:
                f += hashlib.sha256(f).digest()
            left, right = right, left ^ (int.from_bytes(f[:size], "big") & mask)
        x = (left << half) | right
        if x < n:
            return x


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _address(value: str, key: bytes, attempt: int) -> str:
    """An address of the same block, or of none as the given one; once the block counts as full, any."""
    old = ipaddress.ip_address(value)
    blocks = [b for b in _BLOCKS if b.version == old.version] if attempt < FULL else []
    if (block := next((b for b in blocks if old in b), None)) is not None:
        low = int(block.network_address)
        return str(type(old)(low + permute(int(old) - low, block.num_addresses, key, str(block).encode())))
    new = old
    while new is old or any(new in b for b in blocks):
        new = type(old)(permute(int(new), 1 << old.max_prefixlen, key, b"ip%d" % old.version))
    return str(new)


def _iban_valid(value: str) -> bool:
    """Whether the check digits hold: the number with letters as 10 to 35, country and check digits last, is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _format_permute(value: str, key: bytes, kind: str) -> str:
    """The value with every letter and digit moved within its class; what stands in no class, and the format, stay."""
    hexa = next((k for k, s in _HEX.items() if kind == "secret" and set(value) <= s), None)
    places = [(i, hexa or _CLASS_OF[c]) for i, c in enumerate(value) if hexa or c in _CLASS_OF]
    x, n = 0, 1
    for i, k in places:
        x, n = x * len(k) + k.index(value[i]), n * len(k)
    form = "".join(str(_CLASSES.index(_CLASS_OF[c])) + "," if c in _CLASS_OF else c for c in value)
    x = permute(x, n, key, f"{kind}|{form}|".encode() if not hexa else f"{kind}|hex{len(value)}|".encode())
    out = list(value)
    for i, k in reversed(places):
        x, r = divmod(x, len(k))
        out[i] = k[r]
    return "".join(out)


def _widened(kind: str, value: str, new: str, key: bytes, more: int) -> str:
    """A surrogate `more` characters longer than its format: letters in names and addresses, signs of its own kind at the end of others. Letters of no class are replaced too."""
    number = int.from_bytes(hashlib.shake_256(key + f"{kind}|{value}".encode()).digest(32 + len(value) + more), "big")

    def letters(n: int, of: str) -> str:
        nonlocal number
        out = ""
        for _ in range(n):
            number, r = divmod(number, len(of))
            out += of[r]
        return out

    if kind == "name":
        low = "abcdefghijklmnopqrstuvwxyz"
        new = "".join(letters(1, low.upper() if i == 0 or new[i - 1] == " " else low) if c.isalpha() and c not in _CLASS_OF else c for i, c in enumerate(new))
        at = len(new) - (len(new.split(" ")[-1]) > 1)
        return new[:at] + letters(more, _CLASS_OF[new[-1].lower()] if new[-1].lower() in _CLASS_OF else low) + new[at:]
    if kind == "email":
        local, _, domain = new.rpartition("@")
        return f"{local}{letters(more, 'abcdefghijklmnopqrstuvwxyz')}@{domain}"
    return new + letters(more, "0123456789")


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of one entity; each attempt is a permutation of its own format, and one of a longer format from FULL on (but for IP addresses, which have 2^32 or 2^128 places)."""
    new = _permuted(kind, value, key, attempt)
    return new if attempt < FULL or kind == "ip" else _widened(kind, value, new, hmac.new(key, f"{kind}|{attempt}|longer".encode(), hashlib.sha256).digest(), attempt - FULL + 1)


@lru_cache(maxsize=256)
def _turn(given: str, key: bytes) -> tuple[int, ...]:
    """A keyed permutation of a list of given names that leaves none in its place: each takes the place after its own in a keyed order."""
    n = len(GIVEN[given])
    place = [permute(i, n, key, given.encode()) for i in range(n)]
    at = {p: i for i, p in enumerate(place)}
    return tuple(at[(p + 1) % n] for p in place)


def _permuted(kind: str, value: str, key: bytes, attempt: int) -> str:
    key = hmac.new(key, f"{kind}|{attempt}".encode(), hashlib.sha256).digest()
    if kind == "ip":
        return _address(value, key, attempt)
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        if luhn(digits):
            body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, b"card%d" % len(digits))).zfill(len(digits) - 1)
            new = next(body + c for c in "0123456789" if luhn(body + c))
        else:
            x = permute(int(digits), 10 ** len(digits), key, b"number%d" % len(digits))
            while luhn(new := str(x).zfill(len(digits))):
                x = permute(x, 10 ** len(digits), key, b"number%d" % len(digits))
        given = iter(new)
        return "".join(next(given) if c.isdigit() else c for c in value)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, dot, top = domain.rpartition(".")
        return _format_permute(f"{local}@{name}", key, f"email.{top}") + dot + top
    if kind == "iban":
        if _iban_valid(value):
            new = _format_permute(value[4:], key, f"iban{value[:2]}")
            return next(x for x in (f"{value[:2]}{c:02d}{new}" for c in range(2, 99)) if _iban_valid(x))
        new = value[:2] + _format_permute(value[2:], key, f"number{value[:2]}")
        while _iban_valid(new):
            new = value[:2] + _format_permute(new[2:], key, f"number{value[:2]}")
        return new
    if kind == "name":
        words = []
        for w in value.split(" "):
            if (at := _LIST_OF.get(w.lower())) is not None:
                words.append(GIVEN[at[0]][_turn(at[0], key)[at[1]]])
            else:  # the ending shows the gender in many languages, so it stays
                new = _format_permute(w[:-1], key, f"name{w[-1:]}{len(w)}") + w[-1:]
                words.append(new if new.lower() not in _LIST_OF else _format_permute(new[:-1], key, f"name{w[-1:]}{len(w)}") + w[-1:])
        return " ".join(words)
    return _format_permute(value, key, kind)


def canonical(kind: str, value: str) -> str:
    """What equal entities have in common: addresses without case, octets without leading zeros, numbers of phones, cards and accounts without signs between."""
    if kind == "email":
        return value.lower()
    if kind == "ip":
        return str(ipaddress.IPv6Address(value)) if ":" in value else ".".join(str(int(x)) for x in value.split("."))
    if kind in _BARE:
        return "".join(c for c in value if c.isalnum())
    return value


def laid_over(kind: str, value: str, new: str) -> str:
    """The surrogate of a canonical value in the format of `value`."""
    if kind not in _BARE:
        return new
    given = iter(new)
    return "".join(next(given) if c.isalnum() else c for c in value) + "".join(given)


def _ip6(value: str) -> str:
    """The IPv6 address that a run of hexadecimal digits, colons and dots is, without the sentence's own signs; empty where it is none, or one without a digit (such as a name with `::`)."""
    value = value.rstrip(".")
    value = value[:-1] if value.endswith(":") and not value.endswith("::") else value
    try:
        return value if str(ipaddress.IPv6Address(value)) and re.search("[0-9]", value) else ""
    except ValueError:
        return ""


def detect(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, type and value of each entity, in order."""
    at = 0
    while m := _FIND.search(text, at):
        if m.lastgroup == "ip6" and not _ip6(m.group()):  # no address: another entity may begin in it
            at = m.end()
            m = next(filter(None, (_OTHERS.match(text, i) for i in range(m.start(), at))), None)
            if m is None:
                continue
        at = m.end()
        kind, value = m.lastgroup, m.group().rstrip(" ")
        if kind == "ip6":
            kind, value = "ip", _ip6(value)
        while kind == "phone" and sum(c.isdigit() for c in value) > 15:  # a number of the sentence follows
            value = re.sub(r"[ .\-]\d+$", "", value)
        if kind == "phone" and not 9 <= sum(c.isdigit() for c in value) <= 15:
            continue
        if kind == "name" and not all(w[:1].isupper() for w in value.split(" ")):
            value = " ".join(w for w in value.split(" ")[: next(i for i, w in enumerate(value.split(" ")) if not w[:1].isupper())])
            if not value:
                continue
        yield m.start(), m.start() + len(value), kind, value


_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")


def mentions(text: str) -> list[tuple[int, int, str, str, int | None]]:
    """What `detect` finds, and every other mention of a name found by its title: the whole of it, or any one of its words. The fifth field is the number of the word that a mention is of its name. Linear in the text, however many names it has."""
    found = [(*x, None) for x in detect(text)]
    names = sorted({v for _, _, kind, v, _ in found if kind == "name"})
    forms: dict[str, tuple[str, int | None]] = {v: (v, None) for v in names}
    for v in names:
        words = v.split(" ")
        for k in range(len(words) - 1, -1, -1) if len(words) > 1 else ():
            forms.setdefault(words[k], (v, k))
    if not forms:
        return found
    longest, spans = max(v.count(" ") for v in names) + 1, []
    for (_, a, *_), (b, *_) in zip([(0, 0), *found], [*found, (len(text),)]):
        words, k = [m.span() for m in _WORD.finditer(text, a, b)], 0
        while k < len(words):
            start, step = words[k][0], 1
            for n in range(min(longest, len(words) - k), 0, -1):
                end = words[k + n - 1][1]
                if (at := forms.get(text[start:end])) is not None:
                    spans.append((start, end, "name", *at))
                    step = n
                    break
            k += step
    return sorted([*found, *spans], key=lambda x: x[:2])


#: Every entity has a digit, an at sign or one of these in its line.
_MARKS = [b"Mr. ", b"Ms. ", b"Dr. ", b"Sr. ", b"Hr. ", b"Mrs. ", b"Sra. ", b"Fra. ", b"Mme. ", b"Herr ", b"Frau ", b"AKIA", b"gh", b"sk-"]
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(48, 58), 0x40]] = True


def holding(texts: pa.Array) -> np.ndarray:
    """Which texts hold an entity. Lines without any mark are passed over, as no entity goes beyond its line."""
    data, at = K.buffer(texts)
    raw = data.tobytes()
    spots = [np.flatnonzero(_SIGN[data])]
    for m in _MARKS:
        found, spot = [], raw.find(m)
        while spot >= 0:
            found.append(spot)
            spot = raw.find(m, spot + 1)
        spots.append(np.array(found, dtype=np.int64))
    spots = np.concatenate(spots)
    out = np.zeros(len(texts), dtype=bool)
    if not len(spots):
        return out
    starts = np.unique(np.concatenate([[0], np.flatnonzero(data == 10) + 1, at[:-1]]))
    line = np.unique(np.searchsorted(starts, spots, side="right") - 1)
    begin, end = starts[line], np.append(starts, len(data))[line + 1]
    row = np.searchsorted(at, begin, side="right") - 1
    for a, b, r in zip(begin.tolist(), end.tolist(), row.tolist()):
        if not out[r] and next(detect("\n" + raw[a:b].rstrip(b"\n").decode("utf-8") + "\n"), None) is not None:
            out[r] = True
    return out


def _entities(batches):
    for whole in batches:
        for part in K.batches([whole]):
            texts = part.column("text").filter(pa.array(holding(part.column("text"))))
            seen = {(kind, canonical(kind, v)) for t in texts.to_pylist() for _, _, kind, v in detect(t)}
            yield pa.record_batch([pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string())], names=["kind", "entity"])


def _assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """`entities` (kind, entity, attempt) plus `surrogate`."""

    def run(batches):
        for b in batches:
            out = [canonical(k, surrogate(k, v, key, a)) for k, v, a in zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "attempt")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "surrogate"])

    return entities.mapInArrow(run, T.StructType([*entities.schema.fields, T.StructField("surrogate", T.StringType())]))


def moved_entities(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate is another entity of the texts, or another's surrogate.

    Rounds end when the check of all surrogates finds nothing. Of entities that
    meet in one surrogate the smallest keeps it. In a format with too few
    values to go round, such as given names, surrogates get longer.
    """
    entities = settle(docs.select(F.col(text).alias("text")).mapInArrow(_entities, "kind string, entity string").distinct(), "entities")
    given = settle(_assigned(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        # a surrogate must not occur as an entity itself
        real = given.join(entities.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "entity")
        twice = given.groupBy("kind", "surrogate").agg(F.min("entity").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        second = given.join(twice, ["kind", "surrogate"]).filter("entity <> first").select("kind", "entity")
        bad = settle(real.unionByName(second).distinct(), "collisions")
        if bad.isEmpty():
            break
        again = given.join(bad, ["kind", "entity"], "left_semi").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        given = settle(given.join(bad, ["kind", "entity"], "left_anti").unionByName(_assigned(again, key)), "surrogates")
    return given.filter("attempt > 0").select("kind", "entity", "attempt")


def replace_entities(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """`docs` with every entity of `text` replaced, plus `entities` (array of type, start and length in the new text).

    Equal entities get equal surrogates in all documents; different ones get
    different ones. Within a document a name that stands after a title is
    replaced where it stands without one too. Null texts stay null and empty ones empty, with no
    entities; repeated rows stay equal. A column `entities` of the input gives
    way. The few entities that had to move are sent to all tasks while they
    fit in BROADCAST_BYTES, and joined to the texts that hold them otherwise.
    """
    spark = docs.sparkSession
    docs = docs.drop("entities")
    moved_at, text_key = private_name(docs, "moved"), private_name(docs, "text_key")
    moved = settle(moved_entities(docs, key, text), "moved")
    size = moved.agg(F.sum(F.octet_length("entity") + 40)).first()[0] or 0
    found = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("entities", found)])
    kind_of = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def rewrite(t: str, attempts: dict, cache: dict) -> tuple[str, list]:
        out, spans, done, length = [], [], 0, 0
        for a, b, kind, value, word in mentions(t):
            name = canonical(kind, value)
            new = cache.get((kind, name))
            if new is None:
                new = cache[kind, name] = surrogate(kind, name, key, attempts.get((kind, name), 0))
            new = laid_over(kind, value, new) if word is None else new.split(" ")[word]
            out += [t[done:a], new]
            length += a - done
            spans.append({"type": kind, "start": length, "length": len(new)})
            length += len(new)
            done = b
        return ("".join([*out, t[done:]]), spans) if out else (t, [])

    def run(batches, attempts, shared):
        for whole in batches:
            for part in K.batches([whole]):
                cache: dict = {}
                held = np.flatnonzero(holding(part.column(text)))
                moves = part.column(moved_at).take(pa.array(held)).to_pylist() if moved_at in part.schema.names else [None] * len(held)
                done = [rewrite(t, attempts(r), cache if shared else {}) for t, r in zip(part.column(text).take(pa.array(held)).to_pylist(), moves)]
                new, spans = part.column(text), [[] for _ in range(part.num_rows)]
                if len(held):  # only the texts that change are built anew
                    mask = np.zeros(part.num_rows, dtype=bool)
                    mask[held] = True
                    new = pc.replace_with_mask(new, pa.array(mask), pa.array([t for t, _ in done], new.type))
                    for k, (_, s) in zip(held.tolist(), done):
                        spans[k] = s
                columns = [new if n == text else c for c, n in zip(part.columns, part.schema.names) if n != moved_at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind_of)], [*(n for n in part.schema.names if n != moved_at), "entities"])

    if size <= BROADCAST_BYTES // 4:
        cell = spark.sparkContext.broadcast({(r.kind, r.entity): r.attempt for r in moved.collect()})
        return docs.mapInArrow(lambda batches: run(batches, lambda r: cell.value, True), schema)
    held = docs.select(F.md5(text).alias("_key"), F.col(text).alias("text")).mapInArrow(_held, "_key string, kind string, entity string").distinct()
    held = held.join(moved, ["kind", "entity"]).groupBy(F.col("_key").alias(text_key)).agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias(moved_at))
    with_moved = docs.withColumn(text_key, F.md5(text)).join(held, text_key, "left").drop(text_key)
    return with_moved.mapInArrow(lambda batches: run(batches, lambda r: {(x["kind"], x["entity"]): x["attempt"] for x in r or []}, False), schema)


def _held(batches):
    """Entities of each text, by the text's digest."""
    for whole in batches:
        for part in K.batches([whole]):
            rows = {(k, kind, canonical(kind, v)) for k, t in zip(part.column("_key").to_pylist(), part.column("text").to_pylist()) if t for _, _, kind, v in detect(t)}
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["_key", "kind", "entity"])


def op7_surrogates(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates for what was detected, how much that was and of which types. A null text stays null, with a null digest and no entities."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = replace_entities(docs, key=b"framelake demonstration key")
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_sort(F.array_distinct(F.col("entities.type"))).alias("types"), F.sha2("text", 256).alias("text_sha256"), "text")
