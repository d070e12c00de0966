"""Each operator against a brute-force version, an exact round trip or its SQL twin on the smallest tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from pyspark.sql import functions as F

from cohortspark.llm import chat, exact, forest, idfiles, langid, packing, passages, sentencepieces, simhash
from cohortspark.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from helpers import SF, components, shingles, words


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in sorted(t, key=lambda r: r["doc_id"])}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, name):
    from oracle import compare, connect
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) is None


def phrases(text: str, sample: str) -> int:
    """Greedy longest-match parsing by plain substring search."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def test_automaton_parses_like_substring_search():
    r = random.Random(4)
    sample = "".join(r.choice("abc ") for _ in range(300))
    table = langid.suffix_automaton([" abc".index(c) for c in sample], 4)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(1, 60))) for _ in range(50)]
    for text in texts:
        state = count = 0
        for c in text:
            to = table[state, " abc".index(c)]
            if to < 0:
                count, to = count + 1, table[0, " abc".index(c)]
            state = to
        assert count + 1 == phrases(text, sample)


def test_lanes_add_up():
    """The parallel parse equals a plain one, but for at most one phrase a lane."""
    sample = "the cat sat on the mat and the dog ran after the cat " * 3
    model = langid.Model((("en", sample), ("xx", "zzz yyy xxx qqq " * 8)))
    text = ("the dog sat on the cat and ran after the mat " * 40).encode()
    _, _, bits, _ = model.judge(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    letters = sum(c != 0x20 for c in text)
    plain = phrases(text.decode(), model_text(sample)) * model.bits[0] / letters
    assert abs(bits[0] - plain) <= (len(text) / langid.STRETCH + 2) * model.bits[0] / letters


def model_text(s: str) -> str:
    return " ".join(s.split()) + " "


def test_op1_held_out(spark, docs):
    rows = QUERIES["op1_cross_parsing"](spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in docs if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) >= 0.98


def test_language_stage_rejects_languages_that_nobody_taught(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    samples, bounds = langid.fit_bounds(frame)
    foreign = ["Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a dir "
               "qual era e cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura",
               "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu jarki ja omatunto, ja heidan "
               "on toimittava toisiaan kohtaan veljeyden hengessa", "Butun insanlar hur haysiyet ve haklar bakimindan esit dogarlar. Akil ve "
               "vicdana sahiptirler ve birbirlerine karsi kardeslik zihniyeti ile hareket etmelidirler", "привет мир"]
    mixed = frame.select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(foreign)], "doc_id long, text string"))
    assert {r["doc_id"] for r in langid.accepted(mixed, samples, bounds).collect()} == set(docs)


def test_op2_pieces_and_places(spark, docs):
    from tokenizers import Tokenizer
    rows = QUERIES["op2_minimum_bin_slack"](spark, SF).collect()
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
    total = 0
    for k, d in docs.items():
        ids = np.array([*tok.encode(d["text"], add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = [pieces[k][i] for i in range(len(pieces[k]))]
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 2048 for r in own[1:])
        assert all(zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [x for x, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= -(-total // 2048) + 1
    made = packing.sequences(spark.read.parquet(f"{SF}/documents.parquet"), QUERIES["op2_minimum_bin_slack"](spark, SF),
                             tokenizer_path("byte_bpe_50k.json")).collect()
    assert sum(len(r["ids"]) for r in made) == total


def test_fullest_combination_is_the_best():
    r = random.Random(2)
    for _ in range(60):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(6)}
        room = r.randint(1, 60)
        sums = {0}
        for x, n in counts.items():
            sums |= {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
        got = packing._fullest(counts, room)
        assert sum(got) == max(sums) and all(got.count(x) <= counts[x] for x in got)


def fingerprint(text: str, bits: int = 128) -> str:
    w = words_any_case(text)
    terms = [(a, b) for a, b in zip(w, w[1:])] or [(x, "") for x in w]
    votes, total = np.zeros(bits, np.int64), 0
    for a, b in terms:
        weight = min(16, len(a) + len(b))
        total += weight
        for h in range(bits // 64):
            seed = xxhash.xxh64_intdigest(a.encode(), 42)
            seed = xxhash.xxh64_intdigest(b.encode(), seed)
            value = xxhash.xxh64_intdigest(h.to_bytes(4, "little"), seed)
            votes[64 * h:64 * h + 64] += weight * np.array([value >> i & 1 for i in range(64)])
    return "".join(f"{sum(1 << i for i in range(64) if 2 * votes[64 * h + i] > total):016x}" for h in range(bits // 64))


def words_any_case(text: str) -> list[str]:
    from helpers import WORD
    return WORD.findall(text.lower())


def test_op3_against_plain_votes(spark, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op3_simhash"](spark, SF).collect()}
    ids = list(docs)
    for k, after in zip(ids, ids[1:] + ids[:1]):
        text, nxt, r = docs[k]["text"], docs[after]["text"], rows[k]
        q = len(text) // 4
        edited = text[:len(text) - q] + nxt[:q]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        bits = bin(int(r["fingerprint"], 16) ^ int(rows[after]["fingerprint"], 16)).count("1")
        assert r["near_next"] == 1 - bits / 128
    for k in ids[:25]:
        assert rows[k]["fingerprint"] == fingerprint(docs[k]["text"])
    changed = [r["near_edited"] for r in rows.values()]
    assert np.mean(changed) > np.mean([r["near_next"] for r in rows.values()]) + 0.15


def test_radius_search_is_exact(spark):
    r = random.Random(9)
    base = [r.getrandbits(128) for _ in range(60)]
    prints = base + [b ^ sum(1 << p for p in r.sample(range(128), r.randint(0, 6))) for b in base for _ in range(5)]
    rows = [(i, f"{p:032x}") for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = {(x["query_fp"], x["stored_fp"]) for x in simhash.within_radius(df.where("doc_id < 60"), df, 3).collect()}
    want = {(a, b) for _, a in rows[:60] for _, b in rows if bin(int(a, 16) ^ int(b, 16)).count("1") <= 3}
    assert got == want


def test_compact_windows_cover_each_stretch_once():
    r = np.random.default_rng(3)
    for least in (1, 3, 7):
        for n in (0, 2, 9, 40):
            for top in (4, 1 << 60):
                v = r.integers(0, top, n).astype(np.uint64)
                w = passages.compact_windows(v, least)
                for i in range(n):
                    for j in range(i + least - 1, n):
                        own = [c for c, lo, hi in w if lo <= i <= c <= j <= hi]
                        assert len(own) == 1 and v[own[0]] == v[i:j + 1].min()


def test_op4_finds_every_repeated_passage(spark, docs):
    rows = QUERIES["op4_compact_windows"](spark, SF).collect()
    w = {k: words(d["text"]) for k, d in docs.items()}
    first, want = {}, collections.defaultdict(set)
    for k in docs:
        for i in range(len(w[k]) - 49):
            p = tuple(w[k][i:i + 50])
            if first.setdefault(p, k) != k:
                want[k].add(i)
    found = collections.defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append((r["start_word"], r["end_word"]))
        a = {tuple(w[r["doc_id"]][i:i + 5]) for i in range(r["start_word"], r["end_word"] - 4)}
        b = {tuple(w[r["source_id"]][i:i + 5]) for i in range(r["source_start_word"], r["source_end_word"] - 4)}
        assert len(a & b) / len(a | b) >= 0.8 and r["end_word"] - r["start_word"] >= 50 and r["source_id"] < r["doc_id"]
        raw = docs[r["doc_id"]]["text"].encode()[r["start_byte"]:r["end_byte"]].decode()
        assert words(raw) == w[r["doc_id"]][r["start_word"]:r["end_word"]]
    assert all(any(a <= i and i + 50 <= b for a, b in found[k]) for k in want for i in want[k])


def test_common_passage_in_every_document(spark):
    """A passage that all of 400 documents share, and another that two of them have beside it."""
    r = random.Random(7)
    invent = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared, second = invent(70), invent(60)
    rows = [(i, f"{invent(80)} {shared} {second if i in (123, 321) else ''} {invent(30)}") for i in range(400)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {x["doc_id"] for x in got} == set(range(1, 400))
    longest = max((x for x in got if x["doc_id"] == 321), key=lambda x: x["end_word"] - x["start_word"])
    assert longest["source_id"] == 123 and longest["end_word"] - longest["start_word"] >= 130


def test_longer_copies_inside_a_crowded_slice(spark):
    """Twenty texts of one slice share a passage of 55 words; pairs of them share what stands around it as well."""
    r = random.Random(5)
    invent = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = invent(55)
    around = [(invent(12), invent(12)) for _ in range(10)]
    rows = [(i, f"{around[i % 10][0]} {shared} {around[i % 10][1]}") for i in range(20)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    whole = {x["doc_id"]: x["source_id"] for x in got if x["end_word"] - x["start_word"] == 79}
    assert whole == {i: i - 10 for i in range(10, 20)}


def test_stretches_by_their_full_jaccard():
    """A long insertion on either side, a changed word at an end, a stray shared shingle."""
    r = np.random.default_rng(2)
    new = lambda n: r.integers(0, 1 << 62, n).astype(np.uint64)
    copied, other = new(76), new(13)
    with_gap = np.concatenate([copied[:36], other, copied[40:]])       # 9 words put in: 13 new shingles for 4
    for a, b in ((with_gap, copied), (copied, with_gap)):
        (p, q, c, d, jaccard), = passages._spans(np.concatenate([new(60), a, new(60)]), np.concatenate([new(9), b, new(9)]), 46, 0.8)
        assert (p, q, c, d) == (60, 60 + len(a), 9, 9 + len(b)) and jaccard == 72 / 89
    for least_copy in (copied[:45], copied[1:46]):
        (p, q, _, _, jaccard), = passages._spans(np.concatenate([least_copy, new(9)]), np.concatenate([new(9), least_copy, new(9)]), 46, 0.8)
        assert (p, q) == (0, 46) and jaccard == 45 / 46
    stray = np.concatenate([copied, new(12), other[:1], new(40)])
    (p, q, _, _, _), = passages._spans(stray, np.concatenate([other, new(300), copied]), 46, 0.8)
    assert (p, q) == (0, 76)


def test_op4_candidates_miss_one_in_a_million(spark):
    """The functions that op4 uses, counted by its keys, miss a pair at the threshold once in a million at most."""
    text = " ".join(f"w{i}" for i in range(400))
    w = passages._windows(spark.createDataFrame([(1, text)], "doc_id long, text string"), 5, 50, 0.8, "doc_id", "text")
    n = len({r["key"] & passages._FUNCTION for r in w.collect()})
    assert n == passages.hashes_for(0.8) and 0.2**n + n * 0.8 * 0.2**(n - 1) <= 1e-6


def test_op5_equals_the_library(spark, docs):
    rows = QUERIES["op5_sentence_pieces"](spark, SF).collect()
    sp = sentencepieces.piece_encoder(tokenizer_path("piece_bpe_32k.model")).pieces.model
    assert all(r["round_trip"] for r in rows) and len(rows) == len(docs)
    for r in rows:
        ids = sp.encode(docs[r["doc_id"]]["text"])
        assert r["n_pieces"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_best_scores_win_in_a_unigram_model():
    import ahocorasick
    p = sentencepieces.Pieces.__new__(sentencepieces.Pieces)
    p.merges, p.score = False, {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -1.5, "aba": -9.0, "bab": -4.9}
    p.id_of = {x: i for i, x in enumerate(p.score)}
    p.automaton = ahocorasick.Automaton()
    for x, i in p.id_of.items():
        p.automaton.add_word(x, (len(x), x, i))
    p.automaton.make_automaton()
    names = list(p.score)

    def best(t):
        return 0.0 if not t else max(p.score[x] + best(t[len(x):]) for x in names if t.startswith(x))

    for n in range(1, 9):
        for k in range(1 << n):
            t = "".join("ab"[k >> i & 1] for i in range(n))
            got = [names[i] for i in p._known(t)]
            assert "".join(got) == t and abs(sum(p.score[x] for x in got) - best(t)) < 1e-9


def test_op6_further_columns_long_texts_and_cycles(spark):
    """Columns named like the operator's own are left out; a cycle is named next to calls in reverse order; long arguments stay whole."""
    long = "x" * 300_000
    rows = [("c", f"k{i}", i, "search", '{"text": "%s", "limit": 1}' % (long if i == 0 else "t"), [f"k{i + 1}"] if i < 5 else None) for i in range(6)]
    rows += [("d", f"k{i}", i, "search", '{"text": "t", "limit": 1}', [f"k{(i + 1) % 7}"]) for i in range(7)] + [("d", "free", 9, "search", "", None)] * 2
    calls = spark.createDataFrame(rows, "conv string, id string, pos int, name string, arguments string, after array<string>")
    results = spark.createDataFrame([("c", "k0", ""), ("c", "k1", long)], "conv string, id string, content string")
    plain = chat.link_calls(calls, results, chat.tool_schemas(spark))
    clash = ["result", "label", "_spec", "_answers", "tool", "kind", "_v", "_up", "_size", "wave", "want"]
    wide = [t.select("*", *[F.lit(n).alias(n) for n in clash if n not in t.columns]) for t in (calls, results, chat.tool_schemas(spark))]
    order = lambda d: sorted(d.collect(), key=lambda r: (r["conv"], r["id"]))
    got = order(plain)
    assert order(chat.link_calls(*wide)) == got and len(got) == 14
    by = {(r["conv"], r["id"]): r for r in got}
    assert [(by["c", f"k{i}"]["wave"], by["c", f"k{i}"]["depth"]) for i in range(6)] == [(5, 5 - i) for i in range(6)]
    assert all(by["d", f"k{i}"]["status"] == "cycle" and by["d", f"k{i}"]["wave"] is None for i in range(7))
    assert (by["d", "free"]["wave"], by["d", "free"]["status"], by["d", "free"]["canonical"]) == (9, "not json", None)
    assert by["c", "k0"]["result"] == "" and by["c", "k0"]["status"] == "ok" and long in by["c", "k0"]["canonical"] and by["c", "k1"]["result"] == long


def test_op6_cases(spark):
    calls = spark.createDataFrame([
        (1, "a", 1, "search", '{"limit": 3, "text":"x"}', ["b"]), (1, "b", 2, "search", '{"text":"y","limit":"3"}', None),
        (1, "c", 3, "reply", '{"turn":1}', ["b", "gone"]), (1, "d", 4, "nothing", "{}", []), (1, "e", 5, "reply", "not json", []),
        (1, "f", 6, "count", '{"turn":1,"limit":2,"more":{"z":1,"a":[1, 2]}}', []), (1, "a", 9, "reply", "{}", []),
        (2, "x", 1, "count", '{"turn": 1, "limit": 2}', ["y"]), (2, "y", 2, "count", '{"turn":1,"limit":2}', ["x"]),
        (2, "z", 3, "count", '{"turn":1,"limit":2}', ["y"]), (3, "p", 1, "count", '{"limit":2,"turn":1}', ["q"]),
        (3, "q", 2, "count", '{"turn":1,"limit":2}', ["r"]), (3, "r", 3, "count", '{"turn":1,"limit":2}', None), (None, "n", 1, "count", "{}", None)],
        "conv long, id string, pos long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, "a", 'say "hi"\n'), (1, "a", "zz"), (3, "p", None), (3, "r", "done"), (9, "a", "lost")], "conv long, id string, content string")
    got = {(r["conv"], r["id"]): r for r in chat.link_calls(calls, results, chat.tool_schemas(spark)).collect()}
    status = {k: r["status"] for k, r in got.items()}
    assert status == {(1, "a"): "ok", (1, "b"): "wrong limit", (1, "c"): "missing text", (1, "d"): "no tool", (1, "e"): "not json", (1, "f"): "unknown more",
                      (2, "x"): "cycle", (2, "y"): "cycle", (2, "z"): "no result", (3, "p"): "ok", (3, "q"): "no result", (3, "r"): "ok"}
    assert got[1, "a"]["canonical"] == '{"arguments":{"limit":3,"text":"x"},"call":"a","name":"search","result":"say \\"hi\\"\\n"}'
    assert '"more":{"a":[1,2],"z":1}' in got[1, "f"]["canonical"] and got[1, "e"]["canonical"] is None
    order = lambda c: [k[1] for k, r in sorted(((k, r) for k, r in got.items() if k[0] == c), key=lambda x: (x[1]["wave"], x[1]["depth"], x[0]))]
    assert order(3) == ["r", "q", "p"] and order(1).index("b") < order(1).index("a") and order(1).index("b") < order(1).index("c")
    empty = chat.link_calls(calls.limit(0), results.limit(0), chat.tool_schemas(spark))
    assert empty.collect() == []


def test_op7_files(spark, docs):
    from tokenizers import Tokenizer
    tok, path = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), tokenizer_path("word_bpe_49k.json")
    folder = idfiles.fresh_folder(spark)
    idfiles.write_ids(spark.read.parquet(f"{SF}/documents.parquet"), folder, path, 2)
    rows = idfiles.read_ids(spark, folder, path).orderBy("doc_id").collect()
    at = 0
    for (k, d), r in zip(docs.items(), rows, strict=True):
        ids = [*tok.encode(d["text"], add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (k, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert idfiles.read_document(spark, folder, path, 77) == [rows[77]["ids"]] and idfiles.read_document(spark, folder, path, 10**9) == []


def test_op8_even_and_whole(spark, docs):
    rows = QUERIES["op8_label_propagation"](spark, SF).collect()
    size = collections.Counter()
    for r in rows:
        raw = docs[r["doc_id"]]["text"].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and 0 <= r["shard"] < 40
        size[r["shard"]] += r["size"]
    assert len(rows) == len(docs) and max(size.values()) <= max(1.02 * sum(size.values()) / 40, max(r["size"] for r in rows))
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    places = collections.defaultdict(set)
    for r in rows:
        places[docs[r["doc_id"]]["text"]].add(r["shard"])
    groups = collections.Counter(d["text"] for d in docs.values())
    assert sum(len(places[t]) == 1 for t, n in groups.items() if n > 1) >= 0.9 * sum(n > 1 for n in groups.values())


def test_op8_hot_text(spark):
    """A third of all rows are one text: it fills the fewest shards that it needs, give or take a few."""
    from cohortspark.llm import sharding
    r = random.Random(1)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"{i} " + "x" * r.randint(50, 300)) for i in range(3000)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    size = collections.Counter()
    for x in got:
        size[x["shard"]] += x["size"]
    mean = sum(size.values()) / 10
    assert len(got) == 3000 and max(size.values()) < 1.02 * mean and min(size.values()) > 0.98 * mean


@pytest.mark.parametrize("width", [2, 5])
def test_op9_components(spark, docs, width):
    got = forest.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), width=width).collect()
    want = components({k: d["text"] for k, d in docs.items()}, width, 0.8)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingles(docs[r["doc_id"]]["text"], width)) for r in got)


def test_op9_crowded_regions(spark, monkeypatch):
    """A family of near copies far larger than a crowd, with members at all distances, and blocks of a few rows."""
    monkeypatch.setattr(forest, "CROWD", 6)
    monkeypatch.setattr(forest, "BLOCK", 8)
    r = random.Random(5)
    invent = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    base, rows = invent(120), []
    for i in range(160):
        w = list(base)
        for p in r.sample(range(120), r.choice([0, 1, 2, 3, 4, 6, 8, 12])):
            w[p] = invent(1)[0]
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(invent(50))) for i in range(40)]
    got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == components(dict(rows), 2, 0.8)


def test_pipeline_against_plain_version(spark, docs):
    got = corpus_pipeline.run(spark, SF).collect()
    # language: every document of these tables is in a learned language
    seen, exact_kept = set(), {}
    for k, d in docs.items():
        key = " ".join(duckdb_space(d["text"]))
        if key not in seen:
            seen.add(key)
            exact_kept[k] = d["text"]
    comp = components(exact_kept, 5, 0.8)
    near_kept = {k for k in exact_kept if comp[k] == k}
    assert {r["doc_id"] for r in got} == near_kept
    frame = spark.createDataFrame([(k, exact_kept[k]) for k in sorted(near_kept)], "doc_id long, text string")
    spans = passages.repeated_passages(frame).collect()
    cutting = collections.defaultdict(list)
    for s in spans:
        cutting[s["doc_id"]].append((s["start_byte"], s["end_byte"]))
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    total = collections.Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    for k in near_kept:
        raw, at, parts = exact_kept[k].encode(), 0, []
        if k in cutting:
            for a, b in sorted(cutting[k]):
                if a > at:
                    parts.append(raw[at:a])
                at = max(at, b)
            parts.append(raw[at:])
            text = " ".join(x for x in (p.decode().strip(" ") for p in parts) if x)
        else:
            text = exact_kept[k]
        assert total[k] == len(tok.encode(text, add_special_tokens=False).ids) + 1


def duckdb_space(text: str) -> list[str]:
    import re
    return re.split(r"[\x20\x09-\x0D]+", text)


def test_whole_copies_keep_the_smallest(spark, docs):
    rows = exact.content_sort(spark.read.parquet(f"{SF}/documents.parquet"), hot_rows=1).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(tuple(r) for r in rows) == sorted(con.sql(exact.SQL).fetchall())


def test_op8_pairs_that_hold_most_bytes(spark):
    """Nine tenths of all bytes in pairs: nearly every pair ends in one shard, and the shards stay even."""
    from cohortspark.llm import sharding
    r = random.Random(8)
    pairs = ["p" * r.randint(200, 400) + str(i) for i in range(600)]
    rows = [(2 * i + j, t) for i, t in enumerate(pairs) for j in range(2)]
    rows += [(5000 + i, "s" * r.randint(200, 400) + str(i)) for i in range(130)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    size = collections.Counter()
    places = collections.defaultdict(set)
    for x in got:
        size[x["shard"]] += x["size"]
        places[x["doc_id"] // 2].add(x["shard"])
    assert len(got) == len(rows) and max(size.values()) <= 1.03 * sum(size.values()) / 10
    assert sum(len(places[i]) == 1 for i in range(600)) >= 0.95 * 600
