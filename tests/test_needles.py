"""Needles in texts, questions and dossier lines against brute force and golden rows."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import ask, dossier, needles
from test_graph import graph


def test_found_needles_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    hays = [(w, i, word(rng.randint(0, 30))) for i in range(120) for w in (1, 2)] + [(1, 900, None), (1, 901, "")]
    asked = [(w, j, word(rng.choice([0, 1, 2, 3, 4, 6]))) for j in range(40) for w in (1, 2)] + [(1, 990, None), (3, 991, "a")]
    h = spark.createDataFrame(hays, "world_id int, h int, hay string")
    n = spark.createDataFrame(asked, "world_id int, n int, needle string")
    got = sorted((r.h, r.n, r.world_id) for r in needles.containing(h, n).collect())
    assert got == sorted((i, j, w) for w, i, t in hays for v, j, x in asked if w == v and t is not None and x and x in t)


def test_needles_that_begin_alike_meet_few_texts_in_vain(spark):
    """A thousand needles and texts that all begin with one word: by first characters a million pairs would be tested."""
    texts = spark.range(1000).select(F.lit(1).alias("world_id"), F.concat(F.lit("the fact of number "), F.col("id") * 37 + 100_000).alias("hay"))
    asked = spark.range(1000).select(F.lit(1).alias("world_id"), F.concat(F.lit("the fact of number "), F.col("id") * 74 + 100_000).alias("needle"))
    tested, held = needles.candidates(texts, asked).count(), needles.containing(texts, asked).count()
    assert held >= 500 and tested < 20 * held


@pytest.mark.parametrize(
    "question, intent, subject, thing, at",
    [
        ("Who knows the vault's location in the order they learned it?", "who_knows", None, "vault location", None),
        ("Who knows where the map is?", "who_knows", None, "where the map is", None),
        ("What does the Captain know about the hidden vault and when did she learn it?", "knows", "captain", "hidden vault", None),
        ("What does Ann know about a map at scene 12?", "knows", "ann", "map", 12),
        ("What does Ann believe at position 7", "believes", "ann", None, 7),
        ("What does Ann knows now", "knows", "ann", None, None),
        ("What can’t Bob do?", "cannot", "bob", None, None),
        ("What is Bob's job?", "occupation", "bob", None, None),
        ("Where does Bob appear after death?", "after_death", "bob", None, None),
        ("Where does Bob appear after their death?", "after_death", "bob", None, None),
        ("Where is the ring kept?", "located_at", "ring", None, None),
        ("Why is Bob sad?", None, None, None, None),
        (None, None, None, None, None),
    ],
)
def test_question_forms(spark, question, intent, subject, thing, at):
    q = spark.createDataFrame([("q", 1, question)], "question_id string, world_id long, question string")
    r = ask.route(q).first()
    assert (r.intent, r.subject, r.thing, r.at) == (intent, subject, thing, at)


def test_dossier_names_the_other_end(spark):
    rows = [(5, 1, 1, "married_to", 2, None, True, 1, None, 101, "canon"), (6, 1, 1, "enemy_of", 2, None, False, 1, None, 101, "canon"), (7, 1, 1, "member_of", None, "the guild", True, 1, None, 101, "canon")]
    got = {(r.section, r.name, r.text) for r in dossier.lines(graph(spark, rows)).collect()}
    assert got == {("relationship", "N1", "married to N2"), ("relationship", "N1", "not enemy of N2"), ("relationship", "N1", "member of the guild")}
