"""Rows built against each operator's weak spots: regular texts, shared ids, endless texts, crowded groups."""

import hashlib
import itertools
import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import PASSAGE, groups, private, without_repeats

from threadloom.llm import components, op02_substring, op03_pii, op04_line_dedup, op05_secrets, op06_decontamination, op07_lm_scoring, op08_language_id, op09_simhash, op10_mixing
from threadloom.sources.scratch import Scratch


def repeats(spark, rows, block_words=10**9):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op02_substring.dedup_substrings(df, block_words).collect())


def thue_morse(n):
    return ["ab"[k.bit_count() % 2] for k in range(n)]


def test_texts_of_a_regular_build_do_not_collide(spark):
    """Under a polynomial hash modulo 2^64 these two collide as whole texts, and the two long words as well."""
    one = thue_morse(2048)
    other = ["ba"["ab".index(x)] for x in one]
    filled = lambda seq, side: " ".join(w for k, x in enumerate(seq) for w in ([x] if k % 10 else [x, f"{side}{k}"]))
    word, complement = ("".join(thue_morse(1024)), "".join("ba"["ab".index(x)] for x in thue_morse(1024)))
    fillers = [" ".join(f"f{k}" for k in range(10)), " ".join(f"g{k}" for k in range(10))]
    rows = [(1, filled(one, "x")), (2, filled(other, "y")), (3, " ".join(one)), (4, " ".join(other)), (5, f"{fillers[0]} {word} {fillers[1]}"), (6, f"{fillers[0]} {complement} {fillers[1]}")]
    expected = without_repeats(rows)
    assert repeats(spark, rows) == sorted((i, *expected[i]) for i, _ in rows)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (1, 0, 3, 2)])
def test_rows_of_one_id_with_different_texts(spark, order):
    long = " ".join(f"own{k}" for k in range(300))
    rows = [(1, f"{long} {PASSAGE}"), (1, f"other {PASSAGE}"), (2, PASSAGE), (3, f"other {PASSAGE}")]
    got = repeats(spark, [rows[k] for k in order], block_words=300)
    sizes = {(i, n): gone for i, n, gone, _ in got}
    assert len(got) == 4 and sorted((i, n) for i, n, *_ in got) == sorted((i, len(t.split())) for i, t in rows)
    assert sizes[2, 60] == 60 and sizes[3, 61] == 61
    assert sorted((sizes[1, 360], sizes[1, 61])) in ([0, 60], [0, 61])


def test_a_passage_in_every_document(spark):
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(30)) + f" {PASSAGE} " + " ".join(f"e{k}w{j}" for j in range(k % 40))) for k in range(400)]
    rows += [(1000 + k, rows[7][1]) for k in range(200)]
    expected = without_repeats(rows)
    assert repeats(spark, rows, block_words=900) == sorted((i, *expected[i]) for i, _ in rows)


def test_a_copy_whose_words_differ_keeps_them():
    shard = op02_substring.Shard()
    shard.add((1, 0), 0, b"a b c", None)
    assert shard.removed((2, 0), [b"a", b"b", b"c"], (1, 0)).all()
    assert not shard.removed((2, 0), [b"a", b"b", b"d"], (1, 0)).any()


def test_word_hashes_depend_on_every_byte():
    words = ["".join(x) for n in range(1, 10) for x in itertools.islice(itertools.product("ab", repeat=n), 200)] + ["x" * n for n in (7, 8, 9, 511, 512, 513, 5000)] + ["x" * 512 + "y"]
    found = op02_substring.Words(pa.array([" ".join(words)])).hashes()
    assert len(set(found.tolist())) == len(set(words))
    assert hashlib.sha256(found.tobytes()).digest() == hashlib.sha256(op02_substring.Words(pa.array(["skip", " ".join(words)])[1:]).hashes().tobytes()).digest()


def test_many_matches_in_one_text(spark):
    """Tables of numbers and lists of addresses: the cost follows the matches, and spans stay where they are."""
    texts = {1: "12 a " * 100_000, 2: "".join(f"é user{k}@mail.example.org " for k in range(100_000)), 3: "x" + " 10.0.0.1" * 3000 + " ssn 123-45-6789"}
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in op03_pii.op3_columns(op03_pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect()}
    assert time.perf_counter() - began < 60
    for i, text in texts.items():
        assert (*(got[i][f"n_{k}"] for k in op03_pii.BASE), got[i]["base_sha256"]) == private(text)
    assert got[3]["spans"].endswith(f"ssn:{len(texts[3]) - 11}:{len(texts[3])}")


def test_a_window_that_a_third_of_all_documents_hold(spark):
    rows = [(k, f"top\nmiddle\nbottom\nown {k}" if k % 3 == 0 else f"a {k}\nb {k}\nc {k}\nd {k}\na {k}\nb {k}\nc {k}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in op04_line_dedup.dedup_lines(df).collect()}
    assert got == {k: (text if k == 0 else f"own {k}") if k % 3 == 0 else f"a {k}\nb {k}\nc {k}\nd {k}" for k, text in rows}
    plan = op04_line_dedup.dedup_lines(df)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("crowd", [2, 40, 10_000])
def test_crowded_buckets_are_split_without_losing_links(spark, crowd):
    """Fingerprints that all share the bits of a mask: one bucket holds most of them."""
    rng = np.random.default_rng(5)
    free = [i for i in range(64) if not op09_simhash.masks()[4] >> i & 1]
    base = int(rng.integers(0, 2**63))
    prints = [base ^ sum(1 << int(b) for b in rng.choice(free, int(rng.integers(0, 9)), replace=False)) for _ in range(500)]
    prints += [p ^ (1 << int(rng.integers(0, 64))) for p in prints[:60]]
    prints = dict(enumerate(dict.fromkeys(prints)))
    scratch = Scratch(spark)
    df = spark.createDataFrame([(op09_simhash.signed(p), k) for k, p in prints.items()], "fp long, node long")
    got = {r["node"]: r["component"] for r in components.components(op09_simhash.links(df, scratch, crowd), scratch).collect()}
    assert {k: got.get(k, k) for k in prints} == groups(prints)


def test_second_masks_cover_what_the_first_leave_free():
    rng = np.random.default_rng(6)
    for mask in op09_simhash.masks():
        free = [i for i in range(64) if not mask >> i & 1]
        for _ in range(300):
            difference = sum(1 << int(b) for b in rng.choice(free, 3, replace=False))
            assert any(difference & m == 0 for m in op09_simhash.masks(mask))
        assert all(m & mask == mask and (~m & (1 << 64) - 1).bit_count() == 16 for m in op09_simhash.masks(mask))


def test_one_row_of_each_group_stays(spark):
    text, near = " ".join(f"w{k}" for k in range(400)), " ".join(f"w{k}" for k in range(399))
    rows = [(1, text, "a"), (1, text, "b"), (2, near, "c"), (3, "another text of its own", "d"), (3, "shares an id only", "e"), (None, text, "f"), (None, "no id here", "g"), (None, "no id here", "h"), (4, None, "i"), (5, "", "j")]
    got = op09_simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, tag string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(0, "no id here"), (1, text), (3, "another text of its own"), (3, "shares an id only"), (4, "")])
    assert set(got[0].asDict()) == {"doc_id", "text", "tag"}


def test_decontaminate_judges_rows_that_share_an_id(spark):
    passage = " ".join(f"b{k}" for k in range(30))
    rows = [(1, passage), (1, "a clean text"), (None, passage), (None, "clean"), (2, None)]
    kept = op06_decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[1], rows[3], rows[4]]))


def test_long_words_sum_over_all_segmentations():
    """A word beyond any fixed length against a sum of logarithms, and expected counts against it."""
    table = {"▁": (0.1, 0.3), "▁a": (0.2, 0.1), "a": (0.1, 0.2), "ab": (0.05, 0.3), "b": (0.2, 0.1), "aba": (0.01, 0.02)}
    lattice, word = op08_language_id.Lattice(table, 2), "▁" + "abaz" * 60
    for k in range(2):
        ahead = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - 3), j):
                p = table[word[i:j]][k] if word[i:j] in table else op08_language_id.FLOOR if j - i == 1 else 0.0
                if p:
                    ahead[j] = np.logaddexp(ahead[j], ahead[i] + math.log(p))
        assert lattice.log_likelihoods(["b", word[1:], "a"])[1, k] == pytest.approx(ahead[-1], rel=1e-12)
        counts = lattice.expected(word[1:], k)
        letters = sum(len(p) * n for p, n in counts.items())
        assert letters == pytest.approx(len(word) - 60)  # all but z, which is in no piece


def test_languages_and_scores_equal_a_plain_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, table = op08_language_id.fit(docs, sample=40, rounds=2)
    longest = max(map(len, table))
    rows = [(k, r["text"]) for k, r in enumerate(docs.select("text").limit(25).collect())] + [(100, "a" * 300), (101, None), (102, "12 !"), (103, "żółć " * 5)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op08_language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), langs, table).collect()}
    cache = {}

    def likelihood(word, k):
        if (word, k) not in cache:
            ahead, part = [0.0], "▁" + word
            for j in range(1, len(part) + 1):
                arcs = [ahead[i] + math.log(table[part[i:j]][k]) for i in range(max(0, j - longest), j) if part[i:j] in table]
                if part[j - 1] not in table:
                    arcs.append(ahead[j - 1] + math.log(op08_language_id.FLOOR))
                ahead.append(float(np.logaddexp.reduce(arcs)))
            cache[word, k] = ahead[-1]
        return cache[word, k]

    for i, text in rows:
        words = op08_language_id.WORD.findall((text or "").lower())
        if not words:
            assert got[i] == ("und", 0.0)
            continue
        total = np.array([sum(likelihood(w, k) for w in words) for k in range(len(langs))])
        best = int(total.argmax())
        assert got[i][0] == langs[best] and got[i][1] == pytest.approx(1 / np.exp(total - total[best]).sum(), abs=2e-6)


def test_positions_invert_the_integrated_schedules(spark, sf_dir):
    """Demand by a document's position, integrated numerically from the schedule, is what precedes it in its source's queue."""
    rows = op10_mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    sources = sorted({r["source"] for r in rows if r["source"] is not None}, key=str.encode) + [None] * any(r["source"] is None for r in rows)
    for k, source in enumerate(sources):
        weight, slope = (1, 2, 3)[k % 3], op10_mixing.SLOPES[k % 3]
        own = sorted((r for r in rows if r["source"] == source and r["taken"]), key=lambda r: r["position"])
        t = np.linspace(0, 1, 20_001)
        rate = weight * (1 + slope * (2 * t - 1))
        demand = np.r_[0, np.cumsum((rate[1:] + rate[:-1]) / 2)] / ((rate[1:] + rate[:-1]) / 2).sum()
        before = 0
        for r in own:
            assert np.interp(r["position"], t, demand) * r["target"] == pytest.approx(before, abs=2)
            before += r["taken"]
        assert before == pytest.approx(own[0]["target"], abs=1)


def test_mixing_of_ties_and_rows_without_an_id(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e", "s"), (None, "x y", "s"), (None, "x y", "s"), (None, None, None), (2, "z", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op10_mixing.mixed_documents(df).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, op10_mixing.mixed_documents(df.repartition(5)).collect()))


def test_trigram_postings_equal_substring_search():
    texts = pa.array(["skipped", "the api key", "", "ap", "i key", "ends with AKI", "AKIA", None, "xx-aké"])[1:]
    texts = texts.fill_null("")
    names = {"api", "key", "AKI", "KIA", "i k"}
    got = op05_secrets.post(texts, names)
    assert {t: list(x) for t, x in got.items()} == {t: [t in v for v in texts.to_pylist()] for t in names}


def test_rows_that_share_an_id_lose_no_unrepeated_lines(spark):
    """Documents are told apart by their text too; rows without an id come first."""
    a, b, c = ("\n".join(f"{x} line {k}" for k in range(5)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (None, c), (3, c + "\n" + "own"), (None, b[:0]), (2, a)]
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in op04_line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, a, 0), (2, "", 5), (2, b, 0), (None, c, 0), (3, "own", 5), (None, "", 0)}


def test_contamination_is_each_row_s_own(spark, tmp_path):
    """A clean row with the id of a contaminated one, and contaminated rows without an id."""
    passage = " ".join(f"w{k}" for k in range(14))
    clean = " ".join(f"c{k}" for k in range(14))
    rows = [(1, passage), (1, clean), (None, passage + " more"), (None, clean), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in op06_decontamination.op6_decontamination(spark, str(tmp_path)).collect())
    assert got == [(0, 14, 0, 0, False), (0, 15, 14, 1, True), (1, 14, 0, 0, False), (1, 14, 14, 1, True), (2, 0, 0, 0, False)]
    assert sorted(r["text"] or "" for r in op06_decontamination.decontaminate(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()) == ["", clean, clean]


def test_mixing_spreads_one_id(spark):
    """Rows of one id, or of none, lie in many tasks, each source meets its target, and the result is that of a queue in order."""
    rows = [(5 if k % 2 else None, "w " * (k % 7), "ab"[k % 3 > 0]) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # the rows are few
    mixed = op10_mixing.mix(docs)
    got = mixed.collect()
    spark.conf.unset(merging)
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(r["taken"] <= 3 * r["size"] for r in own)
    assert len(got) == 4000 and sum(r["size"] for r in got) == sum(k % 7 for k in range(4000))
    tasks = mixed.sparkSession.read.parquet(next(f for f in mixed.inputFiles() if "/queue/" in f).rsplit("/", 1)[0]).groupBy("task").count().collect()
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 2000


def test_the_head_is_filled_in_part_from_equal_counts(spark):
    rows = [(f"w{k}", 7) for k in range(10)] + [("top", 9), ("low", 1)]
    vocabulary = spark.createDataFrame(rows, "word string, n long")
    for size, expected in ((0, []), (1, ["top"]), (4, ["top", "w0", "w1", "w2"]), (11, ["top", *(f"w{k}" for k in range(10))]), (50, ["top", *(f"w{k}" for k in range(10)), "low"])):
        head, counts, others = op07_lm_scoring.split_head(vocabulary, size)
        assert [w.decode() for w in head] == expected and counts.tolist() == [dict(rows)[w] for w in expected]
        assert sorted(r["word"] for r in others.collect()) == sorted(set(dict(rows)) - set(expected))


def test_too_many_classes_are_refused(spark):
    with pytest.raises(ValueError, match="253"):
        op07_lm_scoring.score_by_classes(spark.createDataFrame([], "doc_id long, text string"), F.lit(False), classes=254)


def most_python_in_a_task(plan):
    """Python functions that one task of a plan runs one after another."""

    def walk(node, above):
        name = node.nodeName()
        here = 0 if "Exchange" in name or "Aggregate" in name or "Repartition" in name else above + ("InArrow" in name)
        children = node.children()
        return max([here, *(walk(children.apply(k), here) for k in range(children.size()))])

    return walk(plan, 0)


def test_no_task_of_the_language_model_keeps_two_python_workers(spark, monkeypatch):
    """Where one Python function reads another's rows each takes a worker, which stays: over 0.51 GB that was 0.4 GB of an executor."""
    seen = []
    to_arrow, table = type(spark.range(0)).toArrow, Scratch.table

    def noted(df):
        seen.append(most_python_in_a_task(df._jdf.queryExecution().sparkPlan()))
        return df

    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: to_arrow(noted(self)))
    monkeypatch.setattr(Scratch, "table", lambda self, name, df: table(self, name, noted(df)))
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 23}" for j in range(20))) for k in range(20)], "doc_id long, text string")
    op07_lm_scoring.score_by_classes(docs, F.col("doc_id") == 3, head_size=12, clustered=6, classes=3)
    assert max(seen) == 1, seen


def test_pair_counts_of_places():
    rng = np.random.default_rng(5)
    for seq in (np.array([7], np.int32), np.array([-1, 3, -1, 2], np.int32), rng.integers(-1, 8, 5000).astype(np.int32)):
        counts = Counter((a, b) for a, b in itertools.pairwise(seq.tolist()) if min(a, b) >= 0)
        pairs, n = op07_lm_scoring.pair_counts(seq, 8)
        assert list(zip(pairs.tolist(), n.tolist(), strict=True)) == sorted((a * 8 + b, k) for (a, b), k in counts.items())
