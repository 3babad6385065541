"""Url templates do not depend on how large the host is, nor end at a level."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from wavequarry.llm import urlfilter


def verdicts(spark, rows):
    pages = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    return {r.page_id: r.verdict for r in urlfilter.judge(pages, [], bad_col="bad").collect()}


def test_a_small_bad_section_of_a_large_host(spark):
    rows = [(f"http://h.org/spam/{k}", True) for k in range(60)] + [(f"http://h.org/s{k % 80}/{k}", False) for k in range(6000)]
    got = verdicts(spark, rows)
    assert all(got[k] == ("block" if k < 60 else "allow") for k in got)


def test_paths_that_differ_from_the_sixth_segment_on(spark):
    rows = [(f"http://h.org/a/b/c/d/e/{'bad' if k % 2 else 'good'}/{k}", k % 2 == 1) for k in range(200)] + [("http://h.org/" + "x/" * 500, None)]
    got = verdicts(spark, rows)
    assert all(got[k] == ("block" if k % 2 else "allow") for k in range(200))


def plain_templates(urls):
    """Template of each (host, segments), level by level."""
    made = [""] * len(urls)
    for level in range(max(len(s) for _, s in urls)):
        n = Counter((h, made[k], s[level]) for k, (h, s) in enumerate(urls) if len(s) > level)
        made = [made[k] + ("" if len(s) <= level else f"/{s[level]}" if n[h, made[k], s[level]] >= urlfilter.LEAST_URLS else "/*") for k, (h, s) in enumerate(urls)]
    return made


def plain_apart(n, bad, all_n, all_bad):
    share = all_bad / all_n if all_n else 0.0
    return n > 0 and all_n > 0 and abs(bad / n - share) > urlfilter.APART * (share * (1 - share) * (1 / n + 1 / all_n)) ** 0.5


def plain_shares(urls, bad):
    """Share of bad urls that each url's merged template is judged by."""
    made = plain_templates(urls)
    at = [(h, tuple(t[1:].split("/")) if t else ("",)) for (h, _), t in zip(urls, made)]
    levels = max((k + 1 for _, t in at for k, s in enumerate(t) if s not in ("*", "")), default=0)
    for level in reversed(range(levels)):
        own = defaultdict(lambda: [0, 0])
        for key, b in zip(at, bad):
            own[key][0] += b is not None
            own[key][1] += b is True
        star = lambda key, mark: (key[0], tuple(mark if k == level else s for k, s in enumerate(key[1])))  # noqa: B023, E731
        every, sides, side = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0, 0]), {}
        for key, (n, b) in own.items():
            every[star(key, "*")][0] += n
            every[star(key, "*")][1] += b
        for key, (n, b) in own.items():
            all_n, all_b = every[star(key, "*")]
            side[key] = "" if not plain_apart(n, b, all_n, all_b) else "high" if b * all_n > all_b * n else "low"
            for k, x in enumerate((n, b, 1)):
                sides[star(key, "*"), side[key]][k] += x
        moved = {}
        for key, (n, b) in own.items():
            side_n, side_b, branches = sides[star(key, "*"), side[key]]
            alone = side[key] != "" and (branches == 1 or plain_apart(n, b, side_n, side_b))
            moved[key] = key if alone else star(key, "*" + side[key])
        at = [moved[key] for key in at]
    total = [sum(b is not None for b in bad), sum(b is True for b in bad)]
    prior = total[1] / total[0] if total[0] else 0.0
    host, own = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for key, b in zip(at, bad):
        for table, k in ((host, key[0]), (own, key)):
            table[k][0] += b is not None
            table[k][1] += b is True
    s = urlfilter.STRENGTH
    return [(own[key][1] + s * (host[key[0]][1] + s * prior) / (host[key[0]][0] + s)) / (own[key][0] + s) for key in at]


def test_the_tree_is_that_of_a_plain_version(spark):
    rng = random.Random(8)
    urls, bad = [], []
    for k in range(1500):
        host, section = rng.choice(["a.org", "b.org", "c.net"]), rng.choice(["news", "spam", "blog", "x", "y", "z"])
        deeper = [rng.choice(["p", "q", str(k)]) for _ in range(rng.randrange(4))]
        urls.append((host, [section, *deeper][: rng.randrange(1, 6)] if rng.random() < 0.98 else []))
        bad.append(None if rng.random() < 0.3 else rng.random() < {"spam": 0.95, "x": 0.6, "news": 0.02}.get(section, 0.2))
    urls += [("d.org", ["only"])] * 3 + [("d.org", ["v" * 5000] + ["w"] * 40)]
    bad += [True, True, None, None]
    rows = [(k, f"http://{h}" + "".join("/" + s for s in path), b) for k, ((h, path), b) in enumerate(zip(urls, bad))]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in urlfilter.judge(pages, [], bad_col="bad").collect()}
    want = plain_shares(urls, bad)
    assert len(got) == len(rows)
    for k, share in enumerate(want):
        assert abs(got[k].bad_share - share) < 1e-9 and got[k].verdict == ("block" if share >= urlfilter.REJECT else "allow"), (rows[k], got[k], share)
    spam = [k for k, (_, path) in enumerate(urls) if path[:1] == ["spam"]]
    assert sum(got[k].verdict == "block" for k in spam) > 0.9 * len(spam)
