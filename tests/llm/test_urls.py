import random
import re

from strandline.llm import urls

RULES = [urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"), urls.Rule("block", "a.example.net", "/e"), urls.Rule("allow", "b-example.net", "/")]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: r.reach, default=None)
    return host, path, best.name if best else None, best.verdict if best else default


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    hosts = ["net", "NET", "example.net", "x.example.net", "a.example.net", "z.A.example.net", "b-example.net", "example.com", "m.example.com", "fr.org", "org", "", "a..net", ".net", "nét.org", "example.net:80", "exampleXnet"]
    given = [None, "", "no scheme", "x://", "http://a/b://c"] + [f"{s}{h}{p}" for s in ("http://", "h://", "") for h in hosts for p in ("", "/", "/en/x?q#f", "/de/", "/fr/a\nb", "?x", "#y", "/EN/", "/e")]
    rng.shuffle(given)
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given + given[:5])], "page_id long, url string, host string")
    want = sorted((i, *map(str, brute(u, RULES))) for i, u in enumerate(given + given[:5]))
    for at_once in (urls.RULES_AT_ONCE, 2):
        monkeypatch.setattr(urls, "RULES_AT_ONCE", at_once)
        assert sorted((r.page_id, *map(str, (r.host, r.path, r.rule, r.verdict))) for r in urls.judge(df, RULES).collect()) == want
    assert {r.verdict for r in urls.judge(df, [], "block").collect()} == {"block"}
    assert urls.judge(df.limit(0), RULES).count() == 0
