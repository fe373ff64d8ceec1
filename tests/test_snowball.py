"""The English Snowball stemmer against pairs of its published sample vocabulary and rules."""

from pyspark.sql import functions as F

from textloom.functions import snowball

WANT = {
    "consign": "consign", "consigned": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consolation": "consol", "consolatory": "consolatori",
    "consolingly": "consol", "consonant": "conson", "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "knightly": "knight", "knives": "knive",
    "knocker": "knocker", "generously": "generous", "general": "general", "communism": "communism", "arsenal": "arsenal", "skies": "sky", "dying": "die", "news": "news",
    "proceed": "proceed", "hopping": "hop", "hoping": "hope", "happily": "happili", "sensational": "sensat", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi",
    "cries": "cri", "ties": "tie", "say": "say", "by": "by", "cry": "cri", "luxuriated": "luxuri", "beautifully": "beauti", "geologist": "geologist", "relational": "relat",
    "yellow": "yellow", "boys": "boy", "agreed": "agre", "feed": "feed", "rolled": "roll", "controlling": "control", "adoption": "adopt", "dog's": "dog", "'tis": "tis", "a": "a",
    "electricity": "electr", "inning": "inning", "early": "earli", "bed": "bed", "sing": "sing", "argument": "argument", "replacement": "replac", "vileness": "vile", "youth": "youth",
}


def test_published_pairs():
    assert {w: snowball.stem(w) for w in WANT} == WANT


def test_normalised_texts(spark):
    rows = [("The Cats' <br />hopes: they're RUNNING, and\nhappily!",), (None,), ("",)]
    t = spark.createDataFrame(rows, "text string")
    got = t.select(snowball.normalised(F.col("text")).alias("all"), snowball.normalised(F.col("text"), remove_stop_words=True).alias("few"), snowball.normalised(F.col("text"), stems=False).alias("plain")).collect()
    assert got[0]["all"] == ["the", "cat", "hope", "they", "re", "run", "and", "happili"]
    assert got[0]["few"] == ["cat", "hope", "run", "happili"]
    assert got[0]["plain"] == ["the", "cats", "hopes", "they", "re", "running", "and", "happily"]
    assert got[1]["all"] is None and got[2]["all"] == []
