
from __future__ import annotations

import html
from urllib.parse import urljoin, urlsplit

import numpy as np

from newsmill.llm import near_duplicates, url_filters


def test_keep_one_keeps_one_row_of_each_class(spark):
    prose = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 9999, 80))
    rows = [(None, prose(1)), (None, prose(1) + " more"), (None, prose(1)), (None, prose(2)), (4, prose(3)), (5, prose(4)), (5, prose(3) + " more"), (6, prose(4) + " more"), (6, prose(4) + " more"), (7, prose(2) + " more"), (None, ""), (None, None)]
    got = near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    heads = sorted((r.doc_id, (r.text or "").split(" ")[0]) if r.doc_id else (0, (r.text or "").split(" ")[0]) for r in got)
    first = lambda seed: prose(seed).split(" ")[0]
    assert heads == sorted([(0, ""), (0, first(1)), (0, first(2)), (4, first(3)), (5, first(4))])


def test_blocks_are_carried_over_all_links(spark):
    site = "https://plain.net"
    forms = ["next.html", "?p=2", "//example.org/es/1", "/a?x=1&amp;y=2", "../up/./b.html", "HTTP://Sub.Example.org/en/1z", "#top", "mailto:a@b", "x&#47;y&#x2E;html", "&amp;lt;", "", ".."]
    tags = ["<link rel=canonical href={}>", "<LINK href='{}' rel='alternate canonical'>", '<meta property="og:url" content="{}">', "<meta http-equiv=refresh content=\"0; url='{}'\">"]
    pages, edges = [], []
    for i, f in enumerate(forms):
        for k, tag in enumerate(tags):
            url = f"{site}/{k}/{i}/d/p{i}.html?q={i}"
            if f or k:  # an unquoted empty value isn't one
                pages.append((url, "<html><link rel=canonical href='/self'>".replace("/self", f"/{k}/{i}/self") + tag.format(f)))
                edges += [(url, f"{site}/{k}/{i}/self"), *([(url, urljoin(url, html.unescape(f)))] if f else [])]
    pages.append((f"{site}/0/4/up/b.html", "none"))
    pages += [(f"{site}/7/from", "<base href='//com.de/x/'><link rel=canonical href='y'>"), ("http://x.com/de/", "<link rel=canonical href='//com.de/x/y'>"), (f"{site}/0/0/d/next.html", "<link rel=canonical href='http://x.com/de/1'>"), (f"{site}/1/1/d/p1.html?p=2", "<meta name=og:url content='http://x.com/de/2'>"), (f"{site}/a?x=1&y=2", "<meta http-equiv=refresh content='1;URL=http://x.com/de/3'>")]
    edges += [(f"{site}/7/from", "http://com.de/x/y"), ("http://x.com/de/", "http://com.de/x/y"), *[(p[0], f"http://x.com/de/{k}") for k, p in enumerate(pages[-3:], 1)]]
    node = lambda u: ((s := urlsplit(u)).netloc.lower() + (s.path or "/" if not s.query else s.path) + ("?" + s.query if s.query else "")) if "://" in u else None

    def verdict(name):
        host, path = name.split("/", 1) if "/" in name else (name, "")
        path = "/" + path.split("?")[0]
        fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: (len(r.host) + len(r.path), r.verdict == "allow")).verdict if fits else None

    part = {n: n for e in edges for n in map(node, e) if n}
    for _ in part:
        for a, b in ((node(a), node(b)) for a, b in edges):
            if a and b:
                part[a] = part[b] = min(part[a], part[b])
    want = {}
    for url, _ in pages:
        n = node(url)
        said = {verdict(m) for m in part if part[m] == part.get(n)}
        want[url] = verdict(n) or ("allow" if "allow" in said else "block" if "block" in said else "allow")
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    got = {pages[r.page_id][0]: r.verdict for r in url_filters.judge(frame, url_filters.links(frame)).collect()}
    assert got == want and sum(v == "block" for v in want.values()) > 12
