"""Every operator and stage on an empty table and on rows with nulls, empty and long texts, ties and clashing columns."""

import pytest

import corpus_pipeline
from cohortspark.llm import exact, forest, idfiles, langid, packing, passages, sentencepieces, sharding, simhash
from cohortspark.llm.queries import tokenizer_path
from helpers import LONG, ROWS, edge_docs, empty_docs

N = len(ROWS)
BPE, WORD, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def ids_store(spark, docs):
    folder = idfiles.fresh_folder(spark)
    idfiles.write_ids(docs, folder, tokenizer_path(WORD), 2)
    return idfiles.read_ids(spark, folder, tokenizer_path(WORD))


RUNS = {
    "language": lambda s, d: langid.predict(d, langid.fit(d)),
    "packing": lambda s, d: packing.pack_documents(d, tokenizer_path(BPE)),
    "simhash": lambda s, d: simhash.fingerprint_edits(d),
    "passages": lambda s, d: passages.repeated_passages(d),
    "pieces": lambda s, d: sentencepieces.encode(d, tokenizer_path(PIECES)),
    "files": ids_store,
    "shards": lambda s, d: sharding.balanced_shards(d, 4),
    "forest": lambda s, d: forest.near_duplicates(d),
    "exact": lambda s, d: exact.content_sort(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, empty_docs(spark)).collect() == []


def test_language_edges(spark):
    d = edge_docs(spark)
    got = {r["doc_id"]: r for r in langid.predict(d, langid.fit(d)).collect()}
    assert len(got) == N - 1                                       # one id comes twice
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4, 5))
    assert got[10]["lang_pred"] == "fr" and got[1]["lang_pred"] == "en" and 0 <= got[8]["score"] <= 1


def test_packing_edges(spark):
    rows = packing.pack_documents(edge_docs(spark), tokenizer_path(BPE)).collect()
    assert sum(r["piece"] == 0 for r in rows) == N
    assert {(r["length"], r["start"]) for r in rows if r["doc_id"] in (2, 3)} == {(1, 0)}
    assert max(r["length"] for r in rows) <= 2048 and sum(r["doc_id"] == 8 for r in rows) > 40


def test_simhash_edges(spark):
    rows = simhash.fingerprint_edits(edge_docs(spark)).collect()
    assert len(rows) == N
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[4]["fingerprint"] == "0" * 32 and by[2]["n_chars"] == 0
    assert by[1]["fingerprint"] == by[6]["fingerprint"] == by[7]["fingerprint"] and by[8]["n_chars"] == len(LONG)
    assert by[8]["near_next"] > 0.9


def test_passage_edges(spark):
    rows = passages.repeated_passages(edge_docs(spark)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in rows} == {(9, 8)}
    assert max(r["end_word"] - r["start_word"] for r in rows) >= 80000


def test_piece_edges(spark):
    rows = sentencepieces.encode(edge_docs(spark), tokenizer_path(PIECES)).collect()
    assert len(rows) == N
    assert all(r["round_trip"] for r in rows if r["doc_id"] != 12)
    assert [r["n_pieces"] for r in rows if r["doc_id"] in (2, 3)] == [0, 0]
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(spark.createDataFrame(rows).select("doc_id", "ids"), tokenizer_path(PIECES)).collect()}
    assert back[8] == LONG and back[4] == " \t\r\n "


def test_file_edges(spark):
    rows = ids_store(spark, edge_docs(spark)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12]
    assert all(r["ids"][-1] == 2 for r in rows) and [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(N)]


def test_shard_edges(spark):
    rows = sharding.balanced_shards(edge_docs(spark), 4).collect()
    assert len(rows) == N and {r["size"] for r in rows if r["doc_id"] == 2} == {16}
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_forest_edges(spark):
    rows = forest.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == N
    comp = {r["doc_id"]: r["component_id"] for r in rows}
    assert comp[6] == comp[7] == 1 and comp[9] == 8 and comp[2] == 2 and comp[3] == 3 and comp[4] == 4 and comp[None] is None
    assert all(r["kept"] for r in rows if r["doc_id"] is None) and {r["n_shingles"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}


@pytest.mark.parametrize("hot", [1000, 1])
def test_exact_edges(spark, hot):
    """``hot`` 1 sends every repeated text through several runs."""
    rows = exact.content_sort(edge_docs(spark), hot_rows=hot).collect()
    assert len(rows) == N
    keep = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows}
    assert keep[6] == keep[7] == keep[1] == (1, 4) and keep[2] == keep[3] == (2, 2) and keep[4] == (4, 1)
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows}) == 10


def test_stages_on_edges(spark):
    d = edge_docs(spark)
    for empty in (True, False):
        docs = empty_docs(spark) if empty else d
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == d.columns and dict(out.dtypes) == dict(d.dtypes), name
            assert (out.count() == 0) == empty, name
    kept = sorted((r["doc_id"] or 0) for r in corpus_pipeline.exact_dedup(spark, d, "").collect())
    assert kept == [0, 1, 2, 4, 5, 8, 9, 10, 11, 12]
    one = {r["doc_id"]: r for r in corpus_pipeline.substring_dedup(spark, d, "").collect()}
    assert one[8]["text"] == LONG and one[9]["n_chars"] == len(one[9]["text"]) < 100 and one[2]["text"] is None
