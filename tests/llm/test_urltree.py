import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossaloom.llm import urltree
from glossaloom.llm.queries import URL_RULES

PAGES = "page_id long, url string, bad boolean, host string, purity string"


def judged(spark, rows, rules=(), **settings):
    frame = spark.createDataFrame([(i, u, b, "x", "y") for i, (u, b) in enumerate(rows)], PAGES)
    made = urltree.judge(frame, list(rules), settings=urltree.TreeRules(**settings)).collect()
    assert sorted(r.page_id for r in made) == list(range(len(rows)))
    return [r for _, r in sorted((r.page_id, r) for r in made)]


@pytest.mark.parametrize("url, host, path", [
    ("http://A.B-c.COM/x/Y?q#z", "a.b-c.com", "/x/Y"), ("x://h?q://no/", "h", ""), ("no scheme", "", ""), (None, "", ""), ("", "", ""),
    ("a://b://c/d", "b:", "//c/d"), ("http://É.com#f", "É.com", ""), ("http:///p", "", "/p"), ("line\n://h\nh/p\nq#", "h\nh", "/p\nq"),
])
def test_host_and_path(spark, url, host, path):
    made = spark.createDataFrame([(url,)], "url string").select(urltree.host_of(F.col("url")), urltree.path_of(F.col("url"))).first()
    assert tuple(made) == (host, path)


def test_longest_rule_wins(spark):
    urls = ["http://example.com/en/1", "http://www.example.com/en/1", "http://a.www.example.com/en/1", "http://www.example.com/de/1", "http://x.net/es/1", "http://x.net/en/1",
            "http://net/fr/", "http://com", "http://notcom/", "http://myexample.com/en/1"]
    made = judged(spark, [(u, None) for u in urls], URL_RULES)
    told = ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", None, "net/fr/", None, None, "com/"]
    assert [r.rule for r in made] == told
    assert [r.verdict for r in made] == ["block", "allow", "allow", "allow", "block", "allow", "block", "allow", "allow", "allow"]


def model(rows, s):
    """The tree by recursion over one host's rows."""
    verdicts = {}
    bound = math.sqrt(0.5 * math.log(2 / s.risk))

    def purity(part, above):
        labels = [b for _, b in part if b is not None]
        return (len(labels) - sum(labels) + s.strength * above) / (len(labels) + s.strength)

    def kind(segment):
        name = re.sub(r"\.[A-Za-z0-9]{1,5}\Z", "", segment)
        return "*digits" if re.fullmatch("[0-9]+", name) else "*mixed" if re.search("[0-9]", name) else "*letters"

    def grow(part, level, node, own):
        if level == s.levels:
            verdicts.update({u: (node, own) for (u, _), _ in part})
            return
        sizes = defaultdict(int)
        for (_, segments), _ in part:
            sizes[segments[level] if level < len(segments) else None] += 1
        names = defaultdict(list)
        for (u, segments), bad in part:
            segment = segments[level] if level < len(segments) else None
            keep = segment is not None and sizes[segment] >= s.least_rows and sizes[segment] >= s.least_share * len(part)
            names["$" if segment is None else "=" + segment if keep else kind(segment)].append(((u, segments), bad))
        groups = []
        for name, own_part in sorted(((n, p) for n, p in names.items() if n != "$"), key=lambda x: (purity(x[1], own), x[0])):
            labels = [b for _, b in own_part if b is not None]
            if groups:
                before = [b for _, b in groups[-1][1] if b is not None]
                far = labels and before and abs(sum(before) / len(before) - sum(labels) / len(labels)) > bound * (1 / math.sqrt(len(before)) + 1 / math.sqrt(len(labels)))
                if not far:
                    groups[-1] = (min(groups[-1][0], name), groups[-1][1] + own_part)
                    continue
            groups.append((name, own_part))
        for name, own_part in groups:
            grow(own_part, level + 1, f"{node}/{name}", purity(own_part, own))
        for (u, _), _ in names.get("$", []):
            verdicts[u] = (f"{node}/$", purity(names["$"], own))

    grow(rows, 0, "", purity(rows, s.prior))
    return verdicts


@pytest.mark.parametrize("settings", [{}, {"levels": 2, "least_share": 0.2, "risk": 0.5}])
def test_tree_equals_a_recursive_model(spark, settings):
    rows = []
    for i in range(600):
        top = ["news", "shop", "spam", "user"][i % 4]
        tail = [f"{i}", f"{i}.html", f"item-{i}", "about", f"{i}/deep/er/{i % 5}"][i % 5]
        bad = None if i % 3 == 0 else top == "spam" or (top == "shop" and i % 7 == 0)
        rows.append((f"http://h.org/{top}//{tail}" + ("/" if i % 2 else ""), bad))
    rows += [("http://h.org", True), ("http://h.org/", False), ("http://h.org/news/$/=x", None), ("http://h.org/*letters/1", None)]
    s = urltree.TreeRules(**settings)
    parsed = [((u, tuple(x for x in u[len("http://h.org") :].split("/") if x)[: s.levels]), b) for u, b in rows]
    expected = model(parsed, s)
    for (url, _), row in zip(rows, judged(spark, rows, **settings)):
        assert (row.template, pytest.approx(row.purity)) == expected[url]
        assert row.verdict == ("block" if row.purity < s.least_purity else "allow")
    spam = [r.verdict for (u, _), r in zip(rows, judged(spark, rows, **settings)) if "/spam/" in u]
    assert set(spam) == {"block"}


def test_nulls_repeats_long_urls_and_an_empty_table(spark):
    rows = [(None, True), ("", None), ("http://a.b/" + "x/" * 5000, None), ("http://a.b/" + "y" * 50000, False), ("http://a.b/1", True), ("http://a.b/1", True)]
    made = judged(spark, rows)
    assert [r.host for r in made] == ["", "", "a.b", "a.b", "a.b", "a.b"] and {r.verdict for r in made} <= {"allow", "block"}
    assert made[4].purity == made[5].purity
    assert urltree.judge(spark.createDataFrame([], PAGES), URL_RULES).count() == 0


def test_a_tree_judges_urls_it_has_not_seen(spark):
    fitted = spark.createDataFrame([("h.org", f"/bad/{i}", True) for i in range(40)] + [("h.org", f"/good/{i}", False) for i in range(40)], "host string, path string, bad boolean")
    tree = urltree.fit(fitted)
    new = spark.createDataFrame([("h.org", "/bad/x9"), ("h.org", "/good/77"), ("h.org", "/else"), ("other.org", "/bad/1")], "host string, path string")
    made = {(r.host, r.path): (r.template, r.purity) for r in urltree.place(new, tree).collect()}
    assert made["h.org", "/good/77"][1] > 0.8 > 0.5 > made["h.org", "/bad/x9"][1] and made["other.org", "/bad/1"] == ("", 0.8)
    assert made["h.org", "/else"][0] == ""
