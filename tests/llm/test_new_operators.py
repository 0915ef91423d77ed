"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import op11_conversations as op11
from threadloom.llm import op12_packing as op12
from threadloom.llm import op13_alignment as op13
from threadloom.llm import tokens

SOLID = re.compile("[^\\x20\\x09-\\x0D]")
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def every_repair(rows):
    """(cost, audit, roles and texts) of the cheapest, ASCII-least edits, from all edits that cost no more than deleting every row."""
    found = []

    def go(i, cost, audit, made):
        if cost > 2 * len(rows):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join((r[:1] or "-") for r, _ in made)):
                found.append((cost, audit, made))
        else:
            role, text, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", made)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                go(i + 1, cost + extra, audit + "K", [*made, (role, text)])
                for to in ("user", "assistant"):
                    go(i + 1, cost + extra + 1, audit + "R", [*made, (to, text)])
        for to in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*made, (to, "")])

    go(0, 0, "", [])
    return min(found, key=lambda x: x[:2])


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def expected_reports(conversations):
    """Of conversations {id: [(turn, role, text)]} without ties of different rows in a turn."""
    out = {}
    for conv, rows in conversations.items():
        kept = []
        for turn, role, text in rows:
            role, text = (" " if x is None else x for x in (role, text))
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marked = faults([r[1:] for r in kept])
        turns = [t for t, *_ in kept if t is not None]
        count = Counter(f for *_, f in marked)
        cost, audit, made = every_repair(marked)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def run_op11(spark, tmp_path, conversations, more=lambda df: df):
    rows = [(c, *r) for c, rs in conversations.items() for r in rs]
    more(spark.createDataFrame(rows, CONVERSATIONS)).write.parquet(f"{tmp_path}/conversations.parquet")
    return {r["conv_id"]: tuple(r)[1:] for r in op11.op11_conversations(spark, str(tmp_path)).collect()}


def test_conversations_equal_every_repair(spark, tmp_path):
    rng, conversations = random.Random(4), {}
    for conv in range(150):
        turns = sorted(rng.sample(range(12), rng.randint(1, 6)))
        role = lambda k: rng.choice(["user", "assistant", "system", "tool", None]) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
        conversations[conv] = [(t, role(k), rng.choice(["Yes.", "No!", "cut", " \n", None, "Why? \t", "é…", "Ok.", "Fine."]) if rng.random() < 0.5 else f"Turn {k}.") for k, t in enumerate(turns)]
    conversations[None] = [(None, "user", "Hello."), (3, "assistant", "Hi.")]
    conversations[500] = [(1, r, t) for r in ("user", "assistant") for t in ("B.", "a.", "Ü!", "z" * 80 + ".")]  # rows of one turn: by role, then by text
    assert run_op11(spark, tmp_path, conversations) == expected_reports(conversations)


def test_conversations_blocks_do_not_show(spark, tmp_path, monkeypatch):
    """Blocks of two rows, so that each conversation is put together from several."""
    monkeypatch.setattr(op11, "BLOCK", 2)
    rng = random.Random(8)
    conversations = {c: [(t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c", ""])) for t in range(7)] for c in range(40)}
    assert run_op11(spark, tmp_path, conversations) == expected_reports(conversations)


def test_conversations_odd_tables(spark, tmp_path):
    assert run_op11(spark, tmp_path / "empty", {}) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    clash = lambda df: df.withColumns({"pos": F.lit("x"), "fault": F.lit(1), "audit": F.lit("K"), "h1": F.lit(0)})
    found = run_op11(spark, tmp_path / "gone", {gone: [(0, "user", "Hi.")]}, clash)
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_conversations_repeated_rows_and_a_hot_one(spark, tmp_path):
    """Repeated rows are duplicates, and one conversation of 3000 turns costs what a plain sweep over its states finds."""
    found = run_op11(spark, tmp_path, {5: [(7, "user", "Hi.")] * 2, 6: [(k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(3000)]})
    assert found[5] == expected_reports({5: [(7, "user", "Hi.")] * 2})[5]
    rows = []
    for k in range(3000):
        fate = zlib.crc32(f"6:{k}".encode()) % 20
        if fate:
            text = {1: "", 2: f"t{k}"}.get(fate, f"t{k}.")
            rows += [("user" if fate == 4 else ("user", "assistant")[k % 2], text)] * (2 if fate == 3 else 1)
    best = {"": (0, "")}  # by last role's initial
    for role, _, fault in faults(rows):
        for _ in range(2):  # inserts before the row
            for s, (c, a) in list(best.items()):
                to = "a" if s == "u" else "u"
                best[to] = min(best.get(to, (c + 5, a + "I")), (c + 5, a + "I"))
        after = {}
        for s, (c, a) in best.items():
            to = "a" if s == "u" else "u"
            after[s] = min(after.get(s, (c + 2, a + "D")), (c + 2, a + "D"))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                way = (c + extra, a + "K") if role[0] == to else (c + extra + 1, a + "R")
                after[to] = min(after.get(to, way), way)
        best = after
    ends = [best[""], best["a"], (best["u"][0] + 5, best["u"][1] + "I")]
    assert found[6][5:7] == min(x for x in ends if x)


def documents(spark, tmp_path, rows, more=lambda df: df):
    more(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "Étion", "don't", "a_b", "x" * 30, "1234567", "…", "über", "漢字", "<|endoftext|>", "<s>", " ", "\t", "\n", "\r\n", "", "", "naïve,", "(x);", "▁" if seed % 2 else "_", "🙂", "͸", "\x00"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", " ", "  ", "\n", " a", "a ", "a  b", " \n b", None, "word " * 9000, "y" * 5000]


def plain_tokens(special_as_text):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = special_as_text
    return made


def test_cuts_are_safe_and_the_two_libraries_agree():
    paths = [public_tokenizers.path(n) for n in (tokens.BYTE_BPE, tokens.BYTE_BPE_RANKS, tokens.PIECE_BPE)]
    assert tokens.cuts_are_safe(paths[0], paths[2])
    for special in (False, True):
        one = plain_tokens(special)
        for text in [t for t in texts(1) if t]:
            assert tokens.byte_ids(text, *paths[:2], special).tolist() == one.encode(text, add_special_tokens=False).ids
            cut = [x for c in tokens.chunks(text, 7) for x in one.encode(c, add_special_tokens=False).ids]
            assert cut == one.encode(text, add_special_tokens=False).ids
    rng, one = random.Random(3), plain_tokens(False)
    settled = [chr(c) for c in range(0x2065) if not tokens.UNSETTLED.match(chr(c))]
    for _ in range(2000):  # each settled character among random ones
        text = "".join(rng.choices(settled, k=12))
        assert tokens.byte_ids(text, *paths[:2]).tolist() == one.encode(text, add_special_tokens=False).ids


def best_fit_decreasing(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = min((k for k in range(len(gaps)) if gaps[k] >= n), key=gaps.__getitem__, default=None)
        if k is None:
            gaps.append(size - n)
        else:
            gaps[k] -= n
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_steps_equal_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 30, 100])
    runs = sorted({rng.randint(1, size): rng.randint(1, 40) for _ in range(20)}.items(), reverse=True)
    moves = op12.best_fit(runs, size)
    assert [m[1] for m in moves] == [sum(m[2] for m in moves[:k]) for k in range(len(moves))]
    assert len({m[3] + k // m[4] for m in moves for k in range(m[2])}) == best_fit_decreasing([n for n, c in runs for _ in range(c)], size)


def check_packing(rows, given, size=2048):
    one, want = plain_tokens(False), Counter()
    for doc_id, text in given:
        ids = [*one.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % size + 1
        for piece, (a, b) in enumerate([(0, first), *((k, k + size) for k in range(first, len(ids), size))]):
            want[doc_id, piece, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= size
    assert len(sequences) == best_fit_decreasing([n for p in sequences.values() for _, n in p], size)


def test_packing_equals_brute_force(spark, tmp_path):
    given = [(k % 90 if k % 7 else None, t) for k, t in enumerate(texts(5))] + [(500, "")] * 300
    sf_dir = documents(spark, tmp_path, [(d, t, "en", "s", 0) for d, t in given], lambda df: df.withColumns({"row": F.lit("x"), "piece": F.lit(1), "at": F.lit(2)}))
    check_packing(op12.op12_packing(spark, sf_dir).collect(), given)
    made = op12.sequences(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40), size=64).collect()
    assert all(len(r["ids"]) <= 64 for r in made) and sum(r["ids"].count(0) for r in made) >= 40
    assert op12.op12_packing(spark, documents(spark, tmp_path / "none", [])).collect() == []


def plain_alignment(given):
    """Whole texts through both libraries."""
    import sentencepiece

    a_model, b_model = plain_tokens(True), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_bytes = tokens.byte_bpe_bytes(public_tokenizers.path("byte_bpe_50k.json"))
    out, docs = [], Counter()
    for doc_id, text in given:
        a, b = ([], []) if not text else (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text))
        pieces = [b_model.id_to_piece(x) for x in b]
        b_parts = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
        whole = (" " + (text or "")).encode()
        groups, links = [], Counter()
        if text and b"".join(b_parts) == whole and b"".join(a_bytes[x] for x in a) == whole:
            ends = []
            for parts in ([a_bytes[x] for x in a], b_parts):
                at, of = 0, []
                for p in parts:
                    at += len(p)
                    of.append(at)
                ends.append(of)
            both, i, j = sorted(set(ends[0]) & set(ends[1])), 0, 0
            for end in both:
                i2, j2 = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
                groups.append((a[i:i2], b[j:j2]))
                links.update((p, q) for p in a[i:i2] for q in b[j:j2])
                i, j = i2, j2
            out.append((doc_id, len(a), len(b), groups, links))
        else:
            out.append((doc_id, 0, 0, groups, links))
        docs.update(links.keys())
    most = Counter()
    for (p, _), n in docs.items():
        most[p] = max(most[p], n)
    for doc_id, n_a, n_b, groups, links in out:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(n for (p, q), n in links.items() if docs[p, q] == most[p])
        yield (doc_id, n_a, n_b, len(groups), sum(links.values()), best, sum(n * docs[x] for x, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("seed", [1, 2])
def test_alignment_equals_whole_texts(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(op13, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(op13, "CHUNK_NUMBERS", 300)
    given = [(k % 90 if k % 7 else None, t) for k, t in enumerate(texts(seed))]
    sf_dir = documents(spark, tmp_path, [(d, t, "en", "s", 0) for d, t in given], lambda df: df.withColumns({"block": F.lit("x"), "nth": F.lit(1), "pair": F.lit(2)}))
    assert Counter(map(tuple, op13.op13_alignment(spark, sf_dir).collect())) == Counter(plain_alignment(given))


def test_alignment_of_nothing(spark, tmp_path):
    assert op13.op13_alignment(spark, documents(spark, tmp_path / "none", [])).collect() == []
    assert [tuple(r) for r in op13.op13_alignment(spark, documents(spark, tmp_path / "blank", [(1, None, None, None, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_pairs_name_the_best(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one three")], "doc_id long, text string")
    pairs = op13.align_documents(docs)[1].collect()
    assert {r["n"] for r in pairs} == {1, 2} and all(r["best"] for r in pairs if r["n"] == 2)


def alignment_block(rng, n):
    """(documents, alignments) of a block with n segments of up to four groups, one of them a long group."""
    groups = lambda: [x for _ in range(rng.integers(1, 5)) for k, m in [rng.integers(1, 4, 2)] for x in (k, m, *rng.integers(0, 300, k + m))]
    made = [groups() for _ in range(n - 1)] + [[70, 80, *rng.integers(0, 300, 150)]]
    numbers = rng.permutation(n)
    packed = op13._pack(numbers, np.array([len(made[k]) for k in numbers]), np.concatenate([made[k] for k in numbers]))
    lengths = np.full(n // 10, 15)
    docs = pa.table({"block": [7], "doc_ids": [list(range(len(lengths)))], "numbers": [op13._pack(lengths, rng.integers(0, n, lengths.sum()))]})
    return made, docs, pa.table({"block": [7], "packed": [packed]})


def test_alignment_block_by_stretches(monkeypatch):
    made, docs, found = alignment_block(np.random.default_rng(3), 400)
    whole = op13.compose_block(docs, found)
    monkeypatch.setattr(op13, "STRETCH_NUMBERS", 40)
    assert op13.compose_block(docs, found).equals(whole)
    numbers = op13._unpack(docs.column("numbers")[0].as_py()[1])[:15]
    said = []
    for x in (made[k] for k in numbers.tolist()):
        at = 0
        while at < len(x):
            k, m = x[at : at + 2]
            said.append(",".join(map(str, x[at + 2 : at + 2 + k])) + "|" + ",".join(map(str, x[at + 2 + k : at + 2 + k + m])))
            at += 2 + k + m
    assert whole.column("digests")[0].as_py()[0] == hashlib.sha256(";".join(said).encode()).hexdigest()


def test_alignment_block_holds_little():
    """All numbers of a block's alignments at once, several times over, took an executor's memory."""
    _, docs, found = alignment_block(np.random.default_rng(3), 60_000)
    tracemalloc.start()
    try:
        op13.compose_block(docs, found)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 75e6, peak
