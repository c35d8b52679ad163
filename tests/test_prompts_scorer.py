import json
import random

from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.functions import prompts as P
from merchantry.functions.text import ws_tokens
from merchantry.operators.fuzzy import token_set_ratio_py, token_set_score


def test_build_prompt_shape(spark):
    df = spark.createDataFrame([("SQ *COFFEE 12",)], "d string")
    p = df.select(P.build_prompt(F.col("d"))).first()[0]
    assert p.startswith("You standardize bank transactions.")
    assert "Allowed categories: " + ", ".join(K.CATEGORIES) in p
    assert p.endswith('Now do this one. Description: "SQ *COFFEE 12"\n' + P.REPLY_RULE)


def test_parse_response(spark):
    replies = ['Sure! {"canonical_merchant": "Starbucks", "category": "Food & Dining"} hope it helps',
               'no json here', '{"canonical_merchant": "A",\n "category": "B"}', '{broken', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = [(x["m"], x["c"]) for x in df.select("i", P.parse_response("r").alias("p"))
           .select("i", F.col("p.merchant").alias("m"), F.col("p.category").alias("c")).orderBy("i").collect()]
    assert got == [("Starbucks", "Food & Dining"), (None, None), ("A", "B"), (None, None), (None, None)]


def test_choice_request_and_parse(spark):
    df = spark.createDataFrame([("COFFEE", ["Starbucks", "Costa"])], "s string, c array<string>")
    req = json.loads(df.select(F.to_json(P.choice_request(F.col("s"), K.CATEGORIES, F.col("c")))).first()[0])
    assert req["state"] == {"description": "COFFEE"}
    assert list(req["questions"]["category"]["criteria"]) == K.CATEGORIES
    crit = req["questions"]["merchant"]["criteria"]
    assert list(crit) == ["Starbucks", "Costa", K.NONE_OPTION] and crit[K.NONE_OPTION] == P.NONE_CRITERION
    reply = json.dumps({"answers": {"merchant": {"choice": "Costa", "confidence": 0.8,
                                                 "probabilities": {"Costa": 0.8, K.NONE_OPTION: 0.1}}},
                        "usage": {"input_tokens": 12}})
    r = spark.createDataFrame([(reply,)], "r string").select(P.parse_choice("r").alias("x")).first()["x"]
    assert (r["merchant"]["choice"], r["merchant"]["p_choice"], r["merchant"]["p_none"]) == ("Costa", 0.8, 0.1)
    assert r["category"]["choice"] is None and r["input_tokens"] == 12


def test_token_set_score_column_matches_python(spark):
    rng = random.Random(5)
    words = ["bp", "f1234", "atlanta", "ga", "mcdonalds", "mcdonald's", "canes", "cane's", "small", "rng", "ring"]
    pairs = [(" ".join(rng.sample(words, rng.randint(1, 3))), " ".join(rng.sample(words, rng.randint(1, 3))))
             for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(token_set_score(ws_tokens("a"), ws_tokens("b"))).collect()]
    want = [token_set_ratio_py(a, b) for a, b in pairs]
    assert [round(x, 9) for x in got] == [round(x, 9) for x in want]
