"""Ids beyond 2 ** 53 beside a null id in one batch, and batches with short texts only."""

import hashlib

import pytest
from pyspark.sql import functions as F

from voxmill.llm import audio, chat, decontaminate, lm, mixing, neardup, quality, repeats, secrets, simhash, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
BIG = 2**60
IDS = [BIG + 1, BIG + 2, None, BIG + 3]
PASSAGE = " ".join(f"p{k}" for k in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [PASSAGE + " one", PASSAGE + " two other words", "no id here " + PASSAGE, "password=hunter2secret alone"]
    return spark.createDataFrame(list(zip(IDS, texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("src1")}).coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).collect()), key=str)


ALL = sorted(IDS, key=str)


def test_ids_survive_text_operators(docs, spark):
    assert ids(secrets.scan_secrets(docs)) == ALL
    assert ids(simhash.simhash_components(docs)) == ALL
    assert ids(lm.interpolated_scores(docs)) == ALL
    assert ids(repeats.remove_repeats(docs)) == ALL
    assert ids(tokens.token_counts(docs, str(public_tokenizers.path("byte_bpe_50k.json")))) == ALL
    assert ids(mixing.mix(docs, {"lang": "lang", "source": "source"}, {}, share=1.0, epochs=1)) == ALL
    labels = spark.createDataFrame([(BIG + 1, 1, 0)], "doc_id long, quality int, toxic int")
    assert ids(quality.resample(docs, labels)) == ALL


def test_repeats_name_the_right_document(docs):
    found = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs).collect()}
    assert found == {BIG + 1: 0, BIG + 2: 60, None: 0, BIG + 3: 0}


def test_leaks_keep_both_ids(docs, spark):
    items = spark.createDataFrame([(BIG + 7, PASSAGE), (BIG + 8, "something else that nobody wrote"), (None, "another item of no id at all")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert found == {(BIG + 1, BIG + 7), (BIG + 2, BIG + 7), (None, BIG + 7)}


def test_near_duplicates_keep_every_document_apart(docs):
    # the passage's copies are alike; the row without id always stays
    assert ids(neardup.keep_first(docs)) == sorted([BIG + 1, None, BIG + 3], key=str)
    assert {r["doc_id"]: r["group_id"] for r in neardup.groups(docs).collect()} == {BIG + 1: BIG + 1, BIG + 2: BIG + 1, BIG + 3: BIG + 3}


def test_conversations_keep_their_ids(spark):
    turns = spark.createDataFrame([(c, k, role, f"{c} {role}") for c in IDS for k, role in enumerate(("user", "assistant"))], "conv_id long, turn int, role string, text string")
    found = {r["conv_id"]: r["turns_sha256"] for r in chat.digests(chat.format_messages(chat.event_log(turns))).collect()}
    assert found == {c: hashlib.sha256(f"user\n{c} user\nassistant\n{c} assistant\n".encode()).hexdigest() for c in IDS}


def test_recordings_keep_their_ids(spark):
    vectors = spark.createDataFrame([(c, [float(k * (i + 1) % 17) / 17 for k in range(64)]) for i, c in enumerate(IDS)], "vec_id long, embedding array<float>")
    assert ids(audio.search(audio.played(vectors), audio.played(vectors.where(f"vec_id = {BIG + 1}"), part=True)), "rec_id") == ALL


@pytest.mark.parametrize("texts", [["a b c", "d e"], ["one"], [None, ""], [" ".join(f"w{k}" for k in range(49))] * 3])
def test_repeats_of_short_texts_only(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeats.remove_repeats(docs).collect()}
    assert found == {k: (len((t or "").split()), 0) for k, t in enumerate(texts)}
