"""Decontamination, phrase mining and conversation repair against brute force, and hot keys of the older operators."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.llm import conversation_repair as R
from demandloom.llm import cover_tree, mixing, packing, phrases, preference, winnowing
from tests.llm.conftest import PASSAGE, prose, table_of

# decontamination


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def contamination_brute(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lowered(text))
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = word.findall(lowered(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (items_of := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= items_of
        spans = [(g[0], len(g)) for g in ([x for _, x in run] for _, run in itertools.groupby(enumerate(sorted(hit)), lambda p: p[1] - p[0]))]
        out.append((doc, len(w), len(hit), spans, sorted(str(x) for x in found - {None})))
    return sorted(out, key=str)


def contaminated(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]) for r in frame.collect()), key=str)


def test_contamination(spark, odd, odd_rows, none):
    upper = PASSAGE.upper().replace(" ", ", ")
    items = [
        (1, upper), (2, PASSAGE + " " + prose(4, 12)), (3, "a b"), (4, "word"), (5, None), (6, " !! "), (None, prose(6, 14)), (7, prose(1, 300)),
        (7, prose(1, 300)), (8, "no no no"), (9, "Ünï cödé ñandú ß 日本 語 Ünï cödé ñandú ß 日本 語"), (10, prose(99, 30)),
    ]
    bench = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, words string, size int").repartition(3)
    want = contamination_brute([(r[0], r[1]) for r in odd_rows], items)
    assert contaminated(winnowing.contamination(odd, bench)) == want
    assert sum(bool(w[2]) for w in want) > 10 and any(not w[2] and w[1] for w in want)
    clean = winnowing.contamination(odd, bench.limit(0)).collect()
    assert len(clean) == len(odd_rows) and not any(r.n_hit or r["items"] or r.spans for r in clean)
    assert winnowing.contamination(none, bench).collect() == []


def test_every_shared_window_is_found(spark):
    """Random words of a small alphabet, so that windows meet by chance, in all lengths of items."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(150)]
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 25, 40] * 2)][1:]
    found = winnowing.contamination(table_of(spark, [(*d, "en", "s") for d in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert contaminated(found) == contamination_brute(docs, items)


# phrases


def phrases_brute(docs, min_count, longest, top, cover=100):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts[lang].update(" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        rows, longer = [], Counter()  # the highest count of a frequent longer phrase that holds it
        for phrase, a in f.items():
            w = phrase.split(" ")
            for k in range(1, len(w) if a >= min_count else 1):
                for i in range(len(w) - k + 1):
                    inner = " ".join(w[i : i + k])
                    longer[inner] = max(longer[inner], a)
        for phrase, a in f.items():
            w = phrase.split(" ")
            if a < min_count or len(w) < 2:
                continue
            if 100 * longer[phrase] >= cover * a:
                continue
            cuts = [(1000 * a * n[lang] // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((lang, phrase, k, a, f[" ".join(w[:k])], f[" ".join(w[k:])], n[lang], score))
        rows.sort(key=lambda r: (-r[7], -r[3], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("min_count,shards,block,cover,top", [(2, 3, 2000, 100, 50), (3, 1, 1 << 20, 60, 2000), (5, 8, 100, 100, 3)])
def test_phrases(spark, odd, odd_rows, min_count, shards, block, cover, top):
    found = phrases.collocations(odd, min_count=min_count, top=top, cover_percent=cover, shards=shards, block_bytes=block)
    want = phrases_brute([(r[1], r[2]) for r in odd_rows], min_count, 5, top, cover)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 5


def test_phrases_of_random_words(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice(["A ", "b ", "c ", "d\t", "e. ", "ß ", "f,", "\n"]) for _ in range(rng.randrange(200))), rng.choice(["x", "y", None]), "s") for i in range(60)]
    found = phrases.collocations(table_of(spark, docs), min_count=6, top=100, block_bytes=1500)
    want = phrases_brute([(d[1], d[2]) for d in docs], 6, 5, 100)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 100


def test_no_phrases(spark, none):
    assert phrases.collocations(none).collect() == []
    assert phrases.collocations(table_of(spark, [(1, None, "en", "a"), (2, " .\n", None, "a")]), min_count=1).collect() == []


def test_phrase_scores_beyond_64_bits(spark):
    """The products of the score pass 64 bits; the quotient does not."""
    big = 10**13
    row = spark.range(1).selectExpr(*[f"cast({big + i} AS bigint) AS {c}" for i, c in enumerate("alrn")])
    wide = {c: f"cast({c} AS decimal(19,0))" for c in "alrn"}
    score = row.selectExpr(f"cast(({wide['a']} * {wide['n']} * 1000) div ({wide['l']} * {wide['r']}) AS bigint) AS s").first().s
    assert score == 1000 * big * (big + 3) // ((big + 1) * (big + 2))


# conversations


def repair_brute(rows):
    """All edits of all rows with up to a few insertions; the cheapest, the least audit."""
    seen, kinds = set(), []
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
        kinds.append((role, blank or again, not blank and not again and last not in ".!?"))
    best = None

    def walk(i, cost, audit, out, inserted):
        nonlocal best
        state = "".join(o[0][:1] for o in out)
        if not re.fullmatch(r"s?(ua)*u?", state) or best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", state) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, [f"{r}:{t}" for r, t in out])
        if inserted < len(rows) + 2:
            for role in ("user", "assistant"):
                walk(i, cost + 2, audit + "I", [*out, (role, "")], inserted + 1)
        if i < len(rows):
            role, gone, cut = kinds[i]
            walk(i + 1, cost + 3, audit + "D", out, inserted)
            if not gone:
                if role[:1] in ("s", "u", "a"):
                    walk(i + 1, cost + cut, audit + "K", [*out, rows[i]], inserted)
                for new in ("user", "assistant"):
                    walk(i + 1, cost + 2 + cut, audit + "R", [*out, (new, rows[i][1])], inserted)

    walk(0, 0, "", [], 0)
    return best


def reports(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv long, turn int, role string, text string, audit string").repartition(3)
    plain = R.plain_rows(frame, *[F.col(c) for c in ("conv", "turn", "role", "text")])
    return {r.conv_id: r for r in R.repair(plain).collect()}, R.repaired_turns(plain).collect()


def test_repairs(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(80):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "bot", ""]), rng.choice(["Hi.", "No", " ", "Yes! \n", "so on?", ""])))
    found, turns = reports(spark, rows)
    for conv in range(80):
        mine = [(r[2], r[3]) for r in rows if r[0] == conv]
        cost, audit, lines = repair_brute(mine)
        assert (found[conv].cost, found[conv].audit) == (cost, audit), mine
        assert found[conv].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out = sorted((t.place, t.edit, t.role, t.text) for t in turns if t.conv_id == conv)
        assert [f"{t[2]}:{t[3]}" for t in out] == lines and "".join(t[1] for t in out) == audit.replace("D", "")


def test_repair_facts_and_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 2, "assistant", "No"), (1, 2, "assistant", "No"), (1, 9, "user", "\t"), (1, None, "system", "Be kind."),
        (None, 3, "user", "Hi."), (None, None, None, None), (2, None, "user", "Hi."), (2, None, "assistant", "Ho."), (3, 1, "umpire", "Out!"), (3, 2, "ASSISTANT", "x."),
    ]
    found, _ = reports(spark, rows)
    facts = lambda c: (found[c].gaps, found[c].blank, found[c].duplicate, found[c].truncated, found[c].illegal)
    assert facts(1) == (7, 1, 1, 1, 1) and (found[1].cost, found[1].audit) == (7, "KKKDD")
    assert facts(None) == (0, 1, 0, 0, 1) and (found[None].cost, found[None].audit) == (5, "DKI")
    assert facts(2) == (0, 0, 0, 0, 0) and (found[2].cost, found[2].audit) == (4, "IKKI")  # of one turn: by role
    assert found[3].cost == 2 and found[3].audit == "KR"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(empty).collect() == [] and R.repaired_turns(empty).collect() == [] and R.damaged(empty).collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t if t % 7 else None, "assistant", "One. Two! Three?") for c in range(20) for t in range(30)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, *{0: (None, None), 1: (role, ""), 2: (role, "One Two Three"), 4: ("user", text)}.get(d, (role, text)))
        want += [row] * (2 if d == 3 else 1)
    assert sorted((tuple(r) for r in R.damaged(frame).collect()), key=str) == sorted(want, key=str)
    gone = R.repair(R.damaged(frame).filter("role IS NULL")).collect()
    assert gone and all((r.cost, r.audit, r.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest()) for r in gone)


def test_long_conversations_go_block_by_block(spark, monkeypatch):
    """Blocks of any size give the same parse; a long conversation takes time in proportion."""
    rng = random.Random(2)
    rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Hi.", "No", " ", f"Yes {i}."])) for i in range(60)]

    def told(block):
        monkeypatch.setattr(R, "BLOCK", block)
        conv = R.Conversation(1)
        for i, (role, text) in enumerate(rows):
            conv.add(i, role, text)
        return conv.report()

    first = told(10**6)
    assert all(told(b) == first for b in (1, 2, 7, 59, 60))
    monkeypatch.setattr(R, "BLOCK", 4096)
    began = time.perf_counter()
    conv = R.Conversation(1)
    for i in range(20_000):
        conv.add(i, ("user", "assistant", "user")[i % 3], f"Text {i}.")
    assert len(conv.report()["audit"]) >= 20_000 and len(conv.rows) < 4096
    assert time.perf_counter() - began < 30


# hot keys and long rows of older operators


def test_one_id_with_many_vectors(spark):
    """An id with several vectors takes one place; rows that differ below 1/256 only are one."""
    rng = np.random.default_rng(4)
    rows = [(50, [1.0, 0.0])] + [(7, [float(x), 0.0]) for x in range(10, 16)] + [(i, [float(rng.random()), 1.0]) for i in range(1, 5)] + [(4, [0.5, 1.0]), (4, [0.5001, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = cover_tree.nearest(frame, block_vectors=4).orderBy("rank").collect()
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -1), int(np.floor(256 * v[0]) * 256))
    assert [(r.vec_id, r.score) for r in found] == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5] and len(found) == 5


def test_vectors_too_large_for_floating_point(spark):
    big = 3.0e7
    rows = [(50, [big, 1.0]), (1, [big, 2.0]), (2, [big, 3.0]), (3, [-big, 1.0]), (4, [1.0, 1.0]), (100, [1.0, 2.0]), (5, [1e300, 1.0])]
    found = cover_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10).collect()
    whole = {i: [int(np.floor(256 * x)) if abs(x) < 2**45 else int(256 * x) for x in v] for i, v in rows}
    cut = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    want = {(q, i, cut(sum(a * b for a, b in zip(whole[q], whole[i], strict=True)))) for q in (50, 100) for i in whole if i != q}
    assert {(r.query_id, r.vec_id, r.score) for r in found} == want


def test_mix_with_one_key_for_most_rows(spark):
    """Rows without id, many of one size: none is lost, and each is taken as often as its place says."""
    rows = [(None, f"{prose(i % 37, 9)} word{i % 37}", "en", "a") for i in range(300)] + [(i, prose(i, 20), "en", "b") for i in range(40)]
    frame = table_of(spark, rows)
    assert mixing.taken_words(frame).count() == 340
    taken = Counter()
    for r in mixing.taken_words(frame).collect():
        taken[r.doc_id, r.size] += r.taken
    mixed = Counter()
    for r in mixing.mixed_documents(frame).collect():
        mixed[r.doc_id, 10 if r.doc_id is None else 20] += len(r.text.split())
    assert mixed == +taken
    texts = Counter(r.text for r in mixing.mixed_documents(frame).filter("doc_id IS NULL").collect())
    assert sum(texts.values()) >= 300 and {t for t in texts if len(t.split()) == 10} == {r[1] for r in rows[:300]}


def test_preferences_of_long_conversations(spark):
    began = time.perf_counter()
    turns = spark.range(8000).selectExpr("1L AS pair", "id % 2 = 0 AS good", "id AS turn", "if(id % 4 < 2, 'user', 'assistant') AS role", "concat('text ', id) AS text")
    row = preference.preference_pairs(turns, *[F.col(c) for c in ("pair", "good", "turn", "role", "text")]).first()
    assert len(row.chosen_spans) == 2000 and row.chosen[row.chosen_spans[-1]["start"] : row.chosen_spans[-1]["end"]].startswith("text 7998\n")
    assert time.perf_counter() - began < 20


def test_packed_pieces_of_a_long_text(spark):
    words = [f"w{i}" for i in range(50_000)]
    frame = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, "a  b\tc"), (3, None)], "doc_id long, text string")
    began = time.perf_counter()
    found = packing.packed_sequences(frame).collect()
    pieces = sorted((p["doc_id"], p["first"], p["words"], p["text"]) for r in found for p in r.pieces)
    assert [p for p in pieces if p[0] == 2] == [(2, 0, 3, "a b c")]
    assert sum(p[2] for p in pieces if p[0] == 1) == 100_000 and all(p[3] == " ".join(words[p[1] : p[1] + p[2]]) for p in pieces if p[0] == 1)
    assert time.perf_counter() - began < 30
