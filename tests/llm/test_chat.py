import hashlib
from collections import defaultdict
from urllib.parse import quote_plus

import duckdb
import pytest
from pyspark.sql import functions as F

from shopflow.llm import chat
from shopflow.llm.common import read_table
from tests.llm.edge import LONG, SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "system", "rules"), (1, 1, "user", "a\\b ## ### #### </turn> <\\/turn>"), (1, 2, "assistant", "\\### Assistant: </turn> ok"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "the end is open"),
    (2, 3, "assistant", "starts #"), (2, 4, "assistant", "# goes on\\"),
    (3, 0, "user", "nobody answers"),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "tie"), (4, None, "user", "first"), (4, 1, "assistant", "é\U0001f600\n\nx"),
    (5, 0, None, "no role"), (5, 1, "wei: rd </turn>\n# rôle", "t"), (5, 2, "assistant", LONG),
    (None, 0, "user", "q"), (None, 1, "assistant", "a"),
]


def escape(text):
    text = text.replace("\\", "\\\\").replace("##", "#\\#").replace("##", "#\\#")
    return text.replace("</turn>", "<\\/turn>")


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        replies = [x for _, r, x in turns if r == "assistant"]
        blocks = [f"### {quote_plus(r, safe='*')}: {escape(x)}</turn>\n" for _, r, x in turns]
        ends = [i for i, (_, r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len("".join(replies)), sha("".join(replies)),
                  sum(len("".join(blocks[:e + 1])) for e in ends), len(ends))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars, r.n_examples) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_digests_equal_brute_force(spark, partitions):
    turns = spark.createDataFrame(ROWS, SCHEMA).repartition(partitions)
    assert got(chat.digests(chat.examples(turns))) == brute(ROWS)


def test_an_example_for_each_reply_with_all_before_as_context(spark):
    rows = chat.examples(spark.createDataFrame(ROWS[:6], SCHEMA)).orderBy("example_no").collect()
    assert [(r.loss_start is None, r.whole) for r in rows] == [(False, False), (False, False), (True, True)]
    assert all(b.text.startswith(a.text) for a, b in zip(rows, rows[1:]))
    first = rows[0]
    assert first.text[first.loss_start:first.loss_end] == escape(ROWS[2][3]) and first.text[first.loss_end:] == "</turn>\n"
    assert "##" not in "".join(t.replace("### ", "", 1) for t in first.text.split("</turn>\n"))


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\\\#", "#", "##", "#" * 9, "#\\#", "</turn>", "<\\/turn>", "</turn></turn>", "\\</turn>#\\", "<<//turn>", "a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r.u == r.t and r.e == escape(r.t) and "##" not in r.e and "</turn>" not in r.e


def test_query_and_sql(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows + [(-7, 0, "user", chat.PROBE_TEXT), (-7, 1, "assistant", chat.PROBE_TEXT)])
    assert got(chat.query(spark, SF)) == want
    from shopflow.llm.sql import ORACLE_SQL
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    sql = con.sql(ORACLE_SQL["op13_prefix_target_chat"])
    assert {r[0]: r[1:] for r in sql.select("conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples").fetchall()} == want


def test_clashing_columns_and_empty_table(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("blocks", "_turn", "_n", "target", "head", "body", "whole", "example_no", "loss_start", "_context"):
        turns = turns.withColumn(name, F.lit("clash"))
    assert got(chat.digests(chat.examples(turns))) == brute(ROWS)
    assert chat.digests(chat.examples(turns.where("false"))).count() == 0
