"""Licences inside longer documents, by whole lines and paragraphs, against a version in plain Python."""

import hashlib
import random
import re
import textwrap

from framelake.llm import license_scan as L

CODE = "import os\n\n\ndef main():\n    return os.getcwd()\n"


def _lines(text):
    x = (text or "").lower()
    for a, b in L.SPELLINGS:
        x = x.replace(a, b)
    x = re.sub(L._COPYRIGHT, "\n", x)
    return [" ".join(re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", " ", y).split()) for y in x.split("\n")]


def _parts(text):
    """The whole text, its paragraphs, and its lines and paragraphs, each in canonical words."""
    lines, paragraphs, at = _lines(text), [], []
    for y in [*lines, ""]:
        if y:
            at.append(y)
        elif at:
            paragraphs.append(" ".join(at))
            at = []
    return " ".join(y for y in lines if y), frozenset(paragraphs), {y for y in lines if y} | set(paragraphs)


def _scan(texts, known):
    whole, groups = {}, {}
    for i, t in known:
        w, p, _ = _parts(t)
        if w:
            whole[w] = min(i, whole.get(w, i))
    for _, t in known:
        w, p, _ = _parts(t)
        if len(p) > 1:
            groups[p] = min(whole[w], groups.get(p, whole[w]))
    for t in texts:
        w, _, have = _parts(t)
        full = [p for p in groups if p <= have]
        found = {whole[x] for x in have if x in whole} | {groups[p] for p in full if not any(p < q for q in full)}
        yield (hashlib.md5(w.encode()).hexdigest() if w else None), whole.get(w), sorted(found)


def _commented(text, mark):
    return "\n".join(f"{mark} {y}".rstrip() for p in text.split("\n\n") for y in [*textwrap.wrap(p, 70), ""])


def test_inside_longer_documents(spark):
    body = {i: t for i, t in L._bodies()}
    two, three = body["BSD-2-Clause"], body["BSD-3-Clause"]
    texts = [
        "# Copyright (c) 2021 Some One\n#\n" + _commented(L._MIT, "#") + "\n" + CODE, "/*\n" + _commented(L._MIT, " *") + "\n */\n\n" + CODE, _commented(L._APACHE, "//") + "\n" + CODE,
        "Licensed under the GNU Lesser General Public License v3.0", "See the MIT license in LICENSE.", "a\nThis project is licensed under the MIT License - see the LICENSE file for details.\nb",
        "intro\n\n" + two + "\n\nend", "intro\n\n" + three + "\n\nend", two + "\n\n" + three + "\n\nmore", "\n\n".join(L._MIT.split("\n\n")[:2]) + "\n\n" + CODE, L._MIT.replace("sell", "lend") + "\n\n" + CODE,
        body["LGPL-2.1"], "x\n\n" + body["GPL-3.0"] + "\n\n" + body["Unlicense"], "This code isn't released under the MIT License.", L._MIT.replace('"', "“", 1).replace('"', "”", 1), None, "", " \n \n", "\n\n".join(reversed(L._MIT.split("\n\n"))),
        body["Zlib"] + CODE, "SPDX-License-Identifier: AGPL-3.0\n" + CODE,
    ]
    texts += [texts[0]] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.digest, r.license_id, r.notices) for r in L.scan_licenses(df).collect()}
    assert len(got) == len(texts) and [got[k] for k in range(len(texts))] == list(_scan(texts, L._known()))
    # document 8 holds both texts, the shorter one with its own title, which is no part of the longer one; the last paragraph of
    # document 19 runs into code, but stands on a line of its own
    stated = [got[k][2] for k in range(21)]
    assert stated == [["MIT"], ["MIT"], ["Apache-2.0"], ["LGPL-3.0"], ["MIT"], ["MIT"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["BSD-2-Clause", "BSD-3-Clause"], [], [], ["LGPL-2.1"], ["GPL-3.0", "Unlicense"], [], ["MIT"], [], [], [], ["MIT"], ["Zlib"], ["AGPL-3.0"]]
    assert [got[k][1] for k in (11, 14)] == ["LGPL-2.1", "MIT"] and all(got[k][2] == ["MIT"] for k in range(21, len(texts)))


def test_against_plain_python(spark):
    """Made-up licences that share paragraphs and whole texts, in documents put together from their paragraphs at random."""
    rng = random.Random(4)
    words = [f"clause {k} says so" for k in range(7)]
    known = [(f"L{rng.randrange(9)}", "\n\n".join(rng.sample(words, rng.randrange(1, 4)))) for _ in range(25)] + [("L0", ""), ("L1", None), ("L2", "clause 1 says\nso"), ("L3", " \n\n ")]
    texts = [rng.choice(["\n\n", "\n \n", "\n# \n", "\n"]).join(rng.choices([*words, "other", "", "clause 1 says\nso", "Clause 2, says so!"], k=rng.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = L.scan_licenses(df, spark.createDataFrame(known, "license_id string, text string")).collect()
    got = {r.doc_id: (r.digest, r.license_id, r.notices) for r in out}
    assert [got[k] for k in range(300)] == list(_scan(texts, known))
    assert all(r.license_id is None and not r.notices for r in L.scan_licenses(df.limit(5), spark.createDataFrame([], "license_id string, text string")).collect())
