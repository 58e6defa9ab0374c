import random
import re

import pytest
from pyspark.sql import functions as F

from tabulon.llm.dialogues import perspectives
from tabulon.llm.queries import URL_RULES
from tabulon.llm.url_rules import judge_urls

RULES = "action string, host string, path string"


def brute_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    hits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/x", "http://a.b.example.org/en/148.html?x#y", "http://example.org/en/1",
        "http://org/", "http://org", "http://x.org?q", "http://x.com/fr/", "http://x.com/FR/", "http://com/de/a", "http://xcom/de/a", "a://b://c/d",
        "http://u:p@x.com:80/fr/1", "http://É.ÀB.com/fr/é", "http://x.com/fr/\nnext", "http://..com/fr/", "http://com./fr/", "http://x.org/" + "y" * 9000,
        "http://" + ".".join("abcdefgh") + ".org/", "http://example.org/en/1", "http://x.com//fr/"]


def random_urls(n, seed=6):
    r = random.Random(seed)
    return ["http" + r.choice(["", "s"]) + "://" + ".".join(r.choice(["a", "example", "www", "org", "com", "Org"]) for _ in range(r.randrange(1, 5)))
            + r.choice(["", "/"]) + "/".join(r.choice(["es", "en", "1", "fr", "de", "", "17"]) for _ in range(r.randrange(4))) + r.choice(["", "?a=/fr/", "#t"])
            for _ in range(n)]


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_verdicts(spark, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rules = URL_RULES + [("block", "www.com", "/"), ("allow", "a.example.org", "/es/1"), ("block", "example.com", "")]
        urls = list(enumerate(URLS + random_urls(300)))
        df = spark.createDataFrame(urls, "page_id long, url string").withColumn("r_key", F.lit(1)).withColumn("host", F.lit("x"))
        rule_rows = spark.createDataFrame(rules + rules[:1] + [(None, "com", "/"), ("block", None, "/"), ("block", "com", None)], RULES)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rule_rows, keep=["page_id"]).collect()}
        assert got == {i: brute_verdict(u, rules) for i, u in urls}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_verdict_edges(spark):
    df = spark.createDataFrame([(1, "http://x.com/fr/"), (1, "http://x.com/fr/"), (None, "http://x.com/de/")], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, RULES)
    got = sorted(((r.page_id, r.verdict) for r in judge_urls(df, rules, keep=["page_id"]).collect()), key=str)
    assert got == [(1, "allow"), (1, "allow"), (None, "block")]
    assert judge_urls(df.limit(0), rules, keep=["page_id"]).count() == 0
    assert {(r.rule, r.verdict) for r in judge_urls(df, rules.limit(0), keep=["page_id"]).collect()} == {(None, "allow")}
    # the same expression with both actions: block wins
    both = spark.createDataFrame([("allow", "com", "/"), ("block", "com", "/")], RULES)
    assert {r.verdict for r in judge_urls(df, both).collect()} == {"block"}
    with pytest.raises(ValueError):
        judge_urls(df.withColumn("rule", F.lit(1)), rules, keep=["rule"])


def test_verdict_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "http://x.com/fr/")], "page_id long, url string")
    plan = judge_urls(df, spark.createDataFrame(URL_RULES, RULES))._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "ArrowEval" not in plan and "InPandas" not in plan


def brute_render(rows, who):
    out, masks = "", []
    key = lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2] or "unknown", r[3] or "")
    for _, _, role, text in sorted(rows, key=key):
        speaker, text = role or "unknown", text or ""
        role = "system" if speaker == "system" else "assistant" if speaker == who else "user"
        head = f"<|im_start|>{role}" + (f" name={speaker}" if role == "user" else "") + "\n"
        if role == "assistant":
            masks.append((len(out) + len(head), len(out) + len(head) + len(text)))
        out += head + text + "<|im_end|>\n"
    return out, masks


@pytest.mark.parametrize("bucket", [2, 64])
def test_perspectives(spark, bucket):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello ann"), (1, 3, "cy", None), (1, 4, "ann", "é😀"), (1, 4, "bob", "tie"),
            (2, 0, None, "who?"), (2, None, "ann", "no turn"), (2, -3, "ann", "before"), (2, 1, "ann", ""), (2, 1, "ann", ""), (3, 0, "system", "alone"),
            (None, 0, "ann", "no conversation"), (None, 1, "bob", "none")] + [(4, i, "ab"[i % 2], f"t{i} " * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit(1)).withColumn("position", F.lit(2))
    got = {}
    for r in perspectives(df, bucket=bucket).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    want = {(c, p) for c, _, p, _ in [(c, t, r or "unknown", x) for c, t, r, x in rows] if p != "system"}
    assert set(got) == want
    for (conv, who), messages in got.items():
        messages.sort(key=lambda r: r.position)
        assert [m.position for m in messages] == list(range(len(messages)))
        text, masks = brute_render([r for r in rows if r[0] == conv], who)
        assert "".join(m.segment for m in messages) == text
        assert [(m.mask_begin, m.mask_end) for m in messages if m.mask_begin is not None] == masks
        at = 0
        for m in messages:
            assert m.char_begin == at
            at += len(m.segment)
    assert perspectives(df.limit(0)).count() == 0
