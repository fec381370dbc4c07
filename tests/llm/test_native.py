import math
import re

from hornlog.llm import licenses, url_filters


def test_url_rules_and_odd_urls(spark):
    urls = [
        "http://a.example.net/de/1", "https://x.EXAMPLE.net/en/2?q", "http://example.com/de/3", "http://b.example.com/fr/4", "http://c.org/fr/5#x", "http://notexample.net",
        "no-scheme", None, "", "http://", "a://b://c/d", "http://net/", "http://xnet/", "http://ÄÖ.net/ä?b", "http://h.org",
    ]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)] + [(0, urls[0], 1), (None, "http://z.org/fr/1", 2)], "page_id bigint, url string, host int")
    outcomes = spark.createDataFrame([], "page_id bigint, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, outcomes).collect()}
    assert got[0] == ("a.example.net", "/de/1", "net/", "block")
    assert got[1] == ("x.example.net", "/en/2", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/3", "example.com/de/", "block")
    assert got[3] == ("b.example.com", "/fr/4", None, "allow")
    assert got[4] == ("c.org", "/fr/5", "org/fr/", "allow") and got[None][2] == "org/fr/"
    assert got[5] == ("notexample.net", "", None, "allow")
    assert got[6][:3] == got[7][:3] == got[8][:3] == got[9][:3] == ("", "", None)
    assert got[10] == ("b:", "//c/d", None, "allow")
    assert got[11][2] == "net/" and got[12][2] is None and got[13] == ("ÄÖ.net", "/ä", "net/", "block")
    assert url_filters.filter_urls(pages, outcomes).count() == len(urls) + 2
    assert url_filters.filter_urls(pages.limit(0), outcomes).count() == 0


def test_reputation_blocks_bad_hosts_only(spark):
    rows = [(k, f"http://bad.spam.com/en/{k}") for k in range(60)] + [(100 + k, f"http://good{k % 20}.fine.org/en/{k}") for k in range(200)] + [(900, "http://new.spam.com/x"), (901, "http://new.fine.org/x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    outcomes = spark.createDataFrame([(k, True) for k in range(50)] + [(0, False), (None, True)] + [(100 + k, k % 20 == 7) for k in range(200)], "page_id bigint, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(pages, outcomes).collect()}
    assert all(got[k] == "block" for k in range(60))  # also pages without an outcome
    assert all(v == "allow" for k, v in got.items() if 100 <= k < 900 and (k - 100) % 20 != 7) and got[901] == "allow"


def brute_headers(text):
    idf, vectors = licenses._weights()
    unknown, found = math.log(1 + len(licenses.TEMPLATES)) + 1, []
    for line in re.split(licenses._LINES, text or ""):
        if not re.search(licenses.CUE, line):
            continue
        terms = re.findall("[a-z0-9]+", line.lower())
        v = {t: (1 + math.log(terms.count(t))) * idf[t] for t in set(terms) if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()) + unknown**2 * len(set(terms) - set(idf)))
        best = max(((round(sum(x * m.get(t, 0) for t, x in v.items()) / norm, 6) if norm else 0), name) for name, m in vectors)
        if best[0] >= licenses.LEAST:
            found.append((best, len(terms)))
    return found


def test_licences_against_brute_force(spark):
    texts = {
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code\nmore code"), ("a/b/y.py", "# This work is licensed under the GNU General Public License, version 3.\nx = 1\n" + "word " * 90),
        ("z/w.txt", "nothing"), ("d/COPYING", "Licensed under the Apache License, Version 2.0."), ("d/LICENSE", "Licensed under the Apache License, Version 2.0, please"), ("d/e/f/g", None), ("d/h", ""),
        ("top", "license"), (None, "Licensed under CC BY-NC 4.0."), ("q/r", "Licensed Licensed licence! " * 3000), ("s/t", "Licensed under CC BY-NC 4.0. Then other words follow here."), ("s/u", "é" * 2000 + " license"),
    }
    rows = [(k, p, t, "clash") for k, (p, t) in enumerate(sorted(texts, key=str))]
    files = spark.createDataFrame([*rows, rows[0]], "file_id bigint, path string, text string, dir string")
    got = {r["file_id"]: r for r in licenses.scan(files).collect()}
    own, granted = {}, {}
    for k, p, t, _ in rows:
        found = brute_headers(t)
        if found:
            sim, name = max(f[0] for f in found)
            own[k] = (name, sim)
            base = (p or "").rsplit("/", 1)
            is_file = bool(re.match(r"(?i)(licen[cs]e|copying|unlicense)(\.|-|$)", base[-1])) or sum(f[1] for f in found) >= licenses.SHARE * len(re.findall("[a-z0-9]+", t.lower()))
            if is_file and p is not None:
                d = base[0] if len(base) > 1 else ""
                granted[d] = min(granted.get(d, (9,)), (-sim, name, k))
    for k, p, t, _ in rows:
        r = got[k]
        if k in own:
            assert (r["license"], r["similarity"]) == own[k] and r["origin"] in ("header", "file")
            continue
        parts = p.split("/")[:-1] if p else []
        up = next((d for d in ("/".join(parts[:n]) for n in range(len(parts), 0, -1)) if d in granted), None)
        assert (r["license"], r["inherited_from"]) == ((granted[up][1], up) if up else (None, None)), p
    assert licenses.scan(files).count() == len(rows) + 1 and licenses.scan(files.limit(0)).count() == 0


def test_licence_files_and_header_blocks(spark):
    """Whole licence files, headers of several lines and SPDX tags, none of which has a line near a one-line template."""
    full = dict(licenses.FULL_TEXTS)
    gpl = "\n".join("# " + x for x in (
        "Copyright (C) 2020 Somebody", "", "This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
        "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version.",
    ))
    rows = [
        (0, "b/LICENSE", "Copyright (c) 2020, Somebody\n\n" + full["BSD-3-Clause"], "BSD-3-Clause", "file"), (1, "b/src/x.c", "int x;", "BSD-3-Clause", "inherited"),
        (2, "i/COPYING", full["ISC"], "ISC", "file"), (3, "a/LICENSE.txt", full["Apache-2.0"], "Apache-2.0", "file"), (4, "g/LICENSE", full["GPL-3.0-only"], "GPL-3.0-only", "file"),
        (5, "l/LICENSE", full["LGPL-3.0-only"], "LGPL-3.0-only", "file"), (6, "h/x.py", gpl + "\n\nx = 1\n" + "word " * 400, "GPL-3.0-or-later", "header"),
        (7, "s/x.py", "# SPDX-License-Identifier: MIT\n" + "y " * 90, "MIT", "header"), (8, "s/y.py", "// SPDX-License-Identifier: Apache-2.0\n" + "y " * 90, "Apache-2.0", "header"),
        (9, "s/z.py", "/* SPDX-License-Identifier: BSD-3-Clause */\n" + "y " * 90, "BSD-3-Clause", "header"), (10, "n/LICENSE", "nothing of the kind " * 9, None, "none"), (11, "n/z", "a warranty of the house", None, "none"),
    ]
    files = spark.createDataFrame([r[:3] for r in rows], "file_id bigint, path string, text string")
    got = {r["file_id"]: (r["license"], r["origin"]) for r in licenses.scan(files).collect()}
    assert got == {r[0]: r[3:] for r in rows}
