"""URL parsing, rules, templates and verdicts."""

import math
import re
from collections import Counter, defaultdict

from opslens.llm.queries import URL_RULES
from opslens.llm.urls import LEVELS, judge


def shape(s):
    plain = re.sub(r"[^0./_-]+", "a", re.sub("[0-9]+", "0", s))
    return "*" + (plain if len(plain) <= 12 else "...")


def brute(pages, labels, rules=URL_RULES, many=8, thin=4.0, least=0.5, weight=5.0, z=2.0):
    good = {}
    for i, g in labels:
        if i is not None and g in (0, 1):
            good[i] = min(g, good.get(i, 1))
    rows = []
    for i, url in pages:
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        rows.append([i, re.sub("[A-Z]", lambda m: m[0].lower(), host), path, path.split("/", LEVELS + 1)[1:], [""]])
    for level in range(max((len(r[3]) for r in rows), default=0)):
        children = defaultdict(Counter)
        for r in rows:
            if len(r[3]) > level:
                children[r[1], r[4][-1]][r[3][level]] += 1
        for r in rows:
            if len(r[3]) > level:
                c = children[r[1], r[4][-1]]
                wide = len(c) >= many and sum(c.values()) < thin * len(c)
                r.append((wide,))
                r[4] = [*r[4], r[4][-1] + "/" + (shape(r[3][level]) if wide else r[3][level])]
    stats = defaultdict(lambda: [0, 0])
    for r in rows:
        if r[0] in good:
            for node in r[4]:
                stats[r[1], node][0] += good[r[0]]
                stats[r[1], node][1] += 1
    seen = [good[r[0]] for r in rows if r[0] in good]
    base = (sum(seen) + 1) / (len(seen) + 2)
    out = []
    for r in rows:
        purity = base
        for node in r[4]:
            g, n = stats[r[1], node]
            if n and abs(g - n * purity) > z * math.sqrt(n * purity * (1 - purity)):
                purity = (g + weight * purity) / (n + weight)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (r[1] == h or r[1].endswith("." + h)) and r[2].startswith(p)]
        rule = max(fits, default=(0, None, None))
        out.append((r[0], r[1], r[2], rule[1], rule[2] or ("block" if purity < least else "allow"), r[4][-1], round(purity, 9)))
    return sorted(out, key=str)


def table():
    pages = [(i, f"http://Shop{i % 2}.example.org/{'item' if i % 3 else 'spam'}/{i}.html?x={i}") for i in range(120)]
    pages += [(200 + i, u) for i, u in enumerate([
        None, "", "no scheme/at/all", "http://", "https://WWW.Example.com/en/1", "https://example.com/en", "https://a.example.com/en/",
        "ftp://x.net/es/1#f", "http://net/fr/", "http://badnet/fr/", "http://y.net/de/", "http://com", "http://q.com?x=/en/", "http://h.org//a//", "x://y://z/Q",
        "http://deep.org/" + "/".join(map(str, range(40))), "http://long.org/" + "p" * 50_000, "http://new.org/a\nb",
    ])]
    pages += [(7, pages[7][1]), (None, "http://shop1.example.org/spam/9.html")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 120, 2)] + [(None, 0), (1, None), (3, 5), (4, 0), (4, 1), (9999, 0)]
    return pages, labels


def test_against_plain_version(spark):
    pages, labels = table()
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "1 as host", "2 as nodes", "3 as good")
    got = judge(frame, spark.createDataFrame(labels, "id long, good int"), URL_RULES).collect()
    assert got[0].__fields__ == ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    assert sorted(((*r[:6], round(r[6], 9)) for r in got), key=str) == brute(pages, labels)
    assert any(r.rule is None and r.verdict == "block" and "/spam/" in r.path for r in got)


def test_no_labels_no_rules_no_pages(spark):
    pages, labels = table()
    frame = spark.createDataFrame(pages, "page_id long, url string")
    none = spark.createDataFrame([], "id long, good int")
    assert {r.verdict for r in judge(frame, none).collect()} == {"allow"}
    assert judge(frame.limit(0), none, URL_RULES).count() == 0


def test_similar_siblings_are_pooled(spark):
    urls = [f"http://h.org/good/{i}" for i in range(454)]
    urls += [f"http://h.org/s{i}/{k}" for i in range(40) for k in range(5)]
    # Single labels scatter as chance has it: the bad ones among them are no group.
    urls += [f"http://g.org/s{i}/{k}" for i in range(40) for k in range(5)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = [(i, 1) for i in range(454)] + [(454 + 5 * i + k, 0) for i in range(40) for k in range(1 + i % 3)] + [(654 + 5 * i, int(i % 6 > 0)) for i in range(40)]
    got = judge(pages, spark.createDataFrame(labels, "id long, good int")).collect()
    assert {r.verdict for r in got if r.path.startswith("/s") and r.host == "h.org"} == {"block"}
    assert {r.verdict for r in got if r.host == "g.org" or r.path.startswith("/good")} == {"allow"}
