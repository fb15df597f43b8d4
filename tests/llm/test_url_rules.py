import random
import re

from orbisect.llm import url_rules as U
from orbisect.llm.queries import URL_RULES

URLS = "page_id long, url string"


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    return host, m[2] if m else ""


def judge(url):
    host, path = parts(url)
    best = None
    for r in URL_RULES:
        own, _, rest = r.text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best.verdict if best else "allow"


def test_rules(spark):
    rng = random.Random(3)
    hosts = ["example.com", "a.EXAMPLE.com", "xexample.com", "com", "b.com", "example.net", "net", "w.example.net", "q.org", "org", "orgs", "é.org", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x=/de/8", "/EN/7", "/de/", "/de/8#a", "/es/é", "/x/com/en/", "?com/en/", "/en"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths] + [None, "", "no scheme/com/en/", "://", "http://a.com/en/" + "y" * 5000, "x\n://b.com/en/\nz", "a://b://c.org/es/"]
    urls += ["http://" + "".join(rng.choice("acemnoprtx./-%") for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), URLS)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judged(df, URL_RULES, chunk=7).collect()}
    assert got == {k: judge(u) for k, u in enumerate(urls)}


def test_globs_against_regular_expressions():
    rng = random.Random(1)
    rules = tuple(U.Rule(f"r{k}" + "x" * k, "".join(rng.choice("ab/*?~") for _ in range(rng.randint(1, 9))), "block") for k in range(60))
    a = U.Automaton(rules)
    assert a.words > 1
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    as_re = [re.compile("".join({"*": ".*", "?": ".", "~": "[^/]*"}.get(c, re.escape(c)) for c in r.glob), re.S) for r in a.rules]
    want = [max((k for k, x in enumerate(as_re) if x.fullmatch(t)), default=-1) for t in texts]
    assert a.match([t.encode() for t in texts]).tolist() == want


def test_rules_end_with_their_host():
    a = U.Automaton((U.path_rule("com", "block"), U.path_rule("a.com", "allow"), U.Rule("g" * 9, "*a?c", "block")))
    fits = lambda t: (k := a.match([t.encode()])[0]) >= 0 and a.rules[k].text or None
    assert [fits(t) for t in (".com", ".b.com/x", ".a.company.org", ".a.com", ".x.a.com/", ".a.comx", ".q.org/com")] == ["com", "com", None, "a.com", "a.com", None, None]
    assert [fits(t) for t in (".aéc", ".a漢c", ".abc", ".a😀c", ".aéé", ".ac", ".aééc")] == ["g" * 9] * 4 + [None] * 3


def test_odd_tables(spark):
    from pyspark.sql import functions as F

    assert U.judged(spark.createDataFrame([], URLS), URL_RULES).collect() == []
    df = spark.createDataFrame([(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, None)], URLS).select("*", *(F.lit(1).alias(n) for n in ("host", "rule", "odd name")))
    assert sorted(str(r.verdict) for r in U.judged(df, URL_RULES).collect()) == ["allow", "block", "block"]
