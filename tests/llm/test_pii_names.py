"""Names, social security numbers and spaced account numbers by weak supervision."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.llm import pii

OPENERS = ["Customer name: {}.", "We met Mr {} there.", "signed {}, yesterday", "my friend {} said so", "Dear {},"]
CLEAN = [
    "the General Public License of this work", "Und Und Und", "in New York City they say", "Stteen Erachtz was written",
    "see Chapter Two for more", "Orre Orre Orre", "nothing here at all", "Lorem Ipsum dolor",
]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(3)
    texts = [None, ""]
    planted = {}
    for i in range(400):
        if i % 4 == 0:
            name = f"{rng.choice(['Maria', 'Peter', 'Sarah', 'Thomas'])} {rng.choice(['Keller', 'Okafor', 'Lindqvist', 'Moreau'])}"
            planted[len(texts)] = name
            texts.append("é😀 " + rng.choice(OPENERS).format(name) + " and so on")
        else:
            texts.append(rng.choice(CLEAN) + " and so on")
    texts += ["account GB82 WEST 1234 5698 7654 32 please", "iban: DE89 3704 0044 0532 0130 00.", "ssn 123-45-6789", "ssn: 123 45 6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find_spans(df).collect()
    return texts, planted, {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["added"]] for r in rows}


def test_names_are_found_and_other_capitals_left(found):
    texts, planted, spans = found
    assert len(spans) == len(texts) and spans[0] == spans[1] == []
    for i, name in planted.items():
        assert spans[i] == [("name", name)], texts[i]
    for i, text in enumerate(texts[: 402]):
        if i not in planted:
            assert not spans[i], text


def test_account_and_social_security_numbers(found):
    texts, _, spans = found
    assert [s for i in range(402, 406) for s in spans[i]] == [
        ("secret", "GB82 WEST 1234 5698 7654 32"),
        ("secret", "DE89 3704 0044 0532 0130 00"),
        ("number", "123-45-6789"),
        ("number", "123 45 6789"),
    ]


def test_check_digits_of_account_numbers(spark):
    numbers = {"GB82 WEST 1234 5698 7654 32": True, "DE89 3704 0044 0532 0130 00": True, "DE89 3704 0044 0532 0130 01": False, "GB82 WEST 1234 5698 7654 23": False}
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert {r[0]: r[1] for r in df.select("n", pii.iban(F.col("n"))).collect()} == numbers


def test_without_any_vote_for_a_person_no_names(spark):
    df = spark.createDataFrame([(i, "Orre Orre and Stteen Erachtz") for i in range(50)], "doc_id long, text string")
    assert pii.find_spans(df).where("size(added) > 0").count() == 0
