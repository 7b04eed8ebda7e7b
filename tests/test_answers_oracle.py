"""Every answer branch (all intents) against the SQL oracle on crafted questions."""

import os
import tempfile

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as E
from tools.check_oracle import rows_key

QUESTIONS = [
    "Which recruiter is underperforming?", "Who is the best recruiter?", "Which client is hardest?",
    "Best client?", "Which source has the best quality?", "Which source brings most candidates?",
    "Which role is hard to hire?", "Where is the biggest funnel bottleneck?", "Why are hires declining?",
    "How many candidates are stuck?", "candidates stuck more than 2000 days", "aging over 0 days",
    "Can we make 250 hires next quarter?", "What is our target?", "hello random question xyz", "   ",
]


def test_answers_all_intents_match_oracle(spark, small_dir):
    d = tempfile.mkdtemp(prefix="hl-questions-")
    for t in ("orders", "customer", "nation", "region"):
        os.symlink(f"{small_dir}/{t}.parquet", f"{d}/{t}.parquet")
    pq.write_table(pa.table({"conv_id": list(range(len(QUESTIONS))), "turn": [0] * len(QUESTIONS),
                             "role": ["user"] * len(QUESTIONS), "text": QUESTIONS}), f"{d}/conversations.parquet")
    sdf = E.queries()["answers"](spark, d)
    srows = [tuple(r) for r in sdf.collect()]
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "region", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    res = con.execute(E.oracle_sql()["answers"])
    dcols = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_key(srows, sdf.columns) == rows_key(res.fetchall(), dcols)
    intents = {r.intent for r in sdf.collect()}
    assert intents >= {"recruiter_ranking", "client_ranking", "source_ranking", "role_ranking", "bottleneck",
                       "declining_hires", "aging_query", "forecast_target", "unknown"}
