"""Arrangement for infilling against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from graphloom.llm import fill_middle

from .conftest import ODD, documents

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(i, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


HARD = ["<P>", "a <S> b <M>", "<", "<P", "P> <<S", "x<S<P>>", " ends in space  ", "\n\nstarts", "   é 😀\u0085x", "< P> <s>", "a" * 100_000 + " b", "<<" * 40, "a<P b<S c<M d"]


def test_arrangements_match_plain_python(spark, corpus):
    rows = corpus + ODD + [(1000 + 40 * k + j, x) for k, x in enumerate(HARD) for j in range(40)]
    docs = documents(spark, rows)
    for seed, rate, spm_rate in ((42, 50, 80), (7, 100, 50), (1, 0, 0)):
        out = fill_middle.arrange(docs, seed, rate, spm_rate)
        assert out.columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"]
        found = out.withColumn("restored", fill_middle.restore_text(F.col("output"), F.col("form"))).collect()
        want = sorted((str(i), *map(str, plain(i, x, seed, rate, spm_rate)), x or "") for i, x in rows)
        assert sorted((str(r[0]), *map(str, r[1:7]), r.restored) for r in found) == want
    assert {r.form for r in fill_middle.arrange(docs, 7, 100, 50).collect()} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fill_middle.arrange(documents(spark, [])).collect() == []


def test_no_python_in_the_plan(spark, corpus):
    out = fill_middle.arrange(documents(spark, corpus))
    plan = out.withColumn("restored", fill_middle.restore_text(F.col("output"), F.col("form")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_very_long_text(spark):
    text = " ".join(f"word{k % 977}" for k in range(400_000)) + "\n" * 50_000
    docs = spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string")
    out = fill_middle.arrange(docs, rate=100)
    assert [r[0] for r in out.select(fill_middle.restore_text(F.col("output"), F.col("form")) == text).collect()] == [True] * 3
