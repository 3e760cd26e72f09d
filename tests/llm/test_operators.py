"""Operators against brute-force versions and their edge cases, on small tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest
from brute import prose
from pyspark.sql import functions as F

from repolumen.llm import (components, decontaminate, fingerprints, mixing, near_dedup, pii, quality, suffix_dedup,
                           token_rollup, toxicity, warc)
from repolumen.session import scratch_path

LONG = prose(99, 40_000)
EDGE = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "One two", 6: "one", 7: LONG, 8: "É é ſ ∞ 𝒳 word"}


def edited(text: str, seed: int, rate: float) -> str:
    rng = random.Random(seed)
    return " ".join(w if rng.random() > rate else f"e{rng.randrange(40)}" for w in text.split())


# ---- near duplicates

def near_rows(rows, width=3, percent=85, table=None):
    got = near_dedup.near_components(table(rows), width, percent).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}


def test_near_duplicates_match_brute_force(table):
    rows = dict(EDGE)
    for g in range(6):
        base = prose(g, 150 + 40 * g)
        rows |= {100 * (g + 1) + k: edited(base, 1000 * g + k, 0.005 * k) for k in range(25)}
    rows |= {900 + k: prose(3, 230) for k in range(30)}
    assert near_rows(rows, table=table) == brute.near(list(rows.items()), 3, 85)
    assert near_rows(rows, 5, 80, table) == brute.near(list(rows.items()), 5, 80)


def test_near_duplicates_in_a_hot_group(table):
    base = prose(5, 120)
    rows = {k: edited(base, k, 0.004 * (k % 20)) for k in range(400)}
    assert near_rows(rows, table=table) == brute.near(list(rows.items()), 3, 85)


def test_near_duplicates_without_ids_and_rows(table, spark):
    text = prose(1, 50)
    got = near_dedup.near_components(table([(None, text), (4, text), (4, text), (None, "alone here now yes")]), 3, 85)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got.collect()) == [
        (0, 0, True), (0, 4, False), (4, 4, True), (4, 4, True)]
    assert near_dedup.near_components(table([(1, "a")]).limit(0)).count() == 0


def test_estimate_follows_similarity(table, spark):
    base = prose(2, 400)
    rows = {0: base, 1: edited(base, 1, 0.02), 2: edited(base, 2, 0.1), 3: prose(77, 400)}
    signed = table(rows).select("doc_id", "text").mapInArrow(
        lambda b: near_dedup._signatures(b, 3), "doc_id long, n_shingles long, set_a long, set_b long, "
        "bands array<long>, bits array<long>")
    first = signed.where("doc_id = 0").select(F.col("bits").alias("x"))
    got = dict(signed.crossJoin(first).select("doc_id", near_dedup.estimated_similarity("bits", "x")).collect())
    for k, text in rows.items():
        a, b = brute.shingles(base, 3), brute.shingles(text, 3)
        assert abs(got[k] - len(a & b) / len(a | b)) < 0.2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long"), "t").collect())
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 300: 300, 301: 300}


# ---- decontamination

def test_contamination_matches_brute_force(table, spark):
    items = {i: prose(500 + i, 8 + 3 * i) for i in range(12)} | {50: None, 51: "", 52: "rare"}
    rows = dict(EDGE) | {20: "x " + items[7] + " y", 21: items[7].upper() + " " + items[3], 22: prose(8, 3000) + " "
                         + " ".join(items[9].split()[4:20]), 23: items[11] + " - " + items[11], 24: "rare", 25: "Rare rare",
                         26: " ".join(items[9].split()[:12]), 27: items[5].replace(" ", "...\n"), 28: items[7]}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids), brute.sha(",".join(r.item_ids)), r.contaminated)
           for r in decontaminate.contamination(table(rows), bench).collect()}
    assert got == brute.contamination(rows.items(), items.items())
    assert decontaminate.contamination(table(rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(table(rows).limit(0), bench).count() == 0


def test_contamination_by_versions_and_items_without_id(table, spark):
    long, short = prose(801, 30), "alpha beta gamma"
    other = " ".join(f"never{k}" if k % 5 == 2 else w for k, w in enumerate(prose(802, 30).split()))
    items = [(1, long), (1, other), (1, short), (2, "q1 q2 " + prose(803, 20)), (None, prose(804, 20)), (3, long)]
    mixed = " ".join(a if k % 2 else b for k, (a, b) in enumerate(zip(long.split(), other.split(), strict=True)))
    rows = {1: long, 2: short + " " + prose(9, 20), 3: mixed, 4: prose(804, 20), 5: prose(803, 20), 6: None, 7: other}
    got = {r.doc_id: (r.n_hit, list(r.item_ids), r.contaminated) for r in decontaminate.contamination(
        table(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    hits = {i: (r[1], r[4]) for i, r in brute.contamination(rows.items(), items).items()}
    assert {i: (n, bad) for i, (n, _, bad) in got.items()} == hits
    assert hits[1][0] == 30 and hits[2][0] == 3 and not hits[3][0] and hits[4] == (20, True)
    assert {i: names for i, (_, names, _) in got.items()} == {
        1: ["1", "3"], 2: ["1"], 3: [], 4: [], 5: ["2"], 6: [], 7: ["1"]}


def test_contamination_plan_is_native(table, spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontaminate.contamination(table({1: "a b c"}), bench)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_proximity_finds_swapped_words(table, spark):
    words = prose(700, 14).split()
    words = [f"{w}{k}" for k, w in enumerate(words)]
    swapped = [words[1], words[0], *words[2:]]
    docs = table({1: "start " + " ".join(swapped), 2: " ".join(reversed(words))}).select("doc_id", "text")
    placed = decontaminate.item_terms(spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    index = decontaminate.build_index(docs, placed.select("term", "word"))
    near = decontaminate.proximity_matches(index, placed.select("item_id", "ipos", "term"), slack=2, window=14)
    exact = decontaminate.phrase_matches(index, placed.select("item_id", "ipos", "term"), 14)
    keys = dict(docs.select(decontaminate.document_key(), "doc_id").collect())
    assert {keys[r.doc] for r in near.collect()} == {1} and exact.count() == 0


# ---- personal data

def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    texts = ["a@b.c x@y @z.q 1.2.3.4 999.1.1.1 4111 1111 1111 1111 +1 (555) 555-1234.", "a@b@c.de", "@@a.b a.@b-.c..d",
             "1.2.3.4.5.6.7.8", "0255.1.1.1", "+12 34", "4111-1111-1111-1111-", "++12345678901", "é@b.c", "a" * 5000]
    texts += ["".join(rng.choice("ab1 2.@+-()3456789\n") for _ in range(300)) for _ in range(400)]
    for text in texts:
        assert pii.base_spans(text) == brute.pii(text), text


def test_model_adds_to_base_spans_only(table):
    rows = {k: f"{prose(k, 12)} {['mail k%d@h%d.example.com', '10.0.%d.%d', '+1 (555) %03d-%04d'][k % 3] % (k, k)} "
               f"{prose(k + 50, 12)}" for k in range(120)} | {200: None, 201: "", 202: "call 1 (555) 555-1234 now"}
    out = {r.doc_id: r for r in pii.personal_data(table(rows)).collect()}
    for k, text in rows.items():
        base = brute.pii_text(brute.pii(text))
        assert out[k].base_sha256 == brute.sha(base)
        assert set(filter(None, base.split(","))) <= set(out[k].spans.split(","))
        assert sum(out[k][f"n_{kind}"] for kind in pii.KINDS) == len(list(filter(None, out[k].spans.split(","))))
    assert pii.personal_data(table({1: "no data"})).first().spans == ""
    assert pii.personal_data(table({1: "no data"}).limit(0)).count() == 0


def test_network_finds_rewritten_spans(table):
    """Spellings that the base patterns miss, in texts that training never saw."""
    def card(k):
        digits = f"4{k:07d}1234{k % 1000:03d}"
        return digits + next(c for c in "0123456789" if pii.luhn(digits + c))
    kinds = [lambda k: f"k{'abcdefgh'[k % 8] * 3}.{'xyz'[k % 3]}@{'mnop'[k % 4]}st.example.com", card,
             lambda k: f"+1 (555) {k % 900 + 100:03d}-{k % 9000 + 1000:04d}"]
    rows = {k: f"{prose(k, 12)} {kinds[k % 3](k)} {prose(k + 50, 12)}" for k in range(240)}
    model, found, wanted = pii.train(table(rows)), [0] * 4, [0] * 4
    for k in range(1000, 1060):
        kind = (0, 2, 3)[k % 3]
        span = pii.rewritten(kind, kinds[k % 3](k), k // 3)
        text = f"{prose(k, 9)} {span} {prose(k + 7, 9)}"
        begin = len(prose(k, 9)) + 1 + 4 * span.startswith("tel ")
        assert not brute.pii(text)
        wanted[kind] += 1
        found[kind] += (begin, kind, len(prose(k, 9)) + 1 + len(span)) in pii.all_spans([text], model)[0][1]
    assert all(f >= 0.8 * w for f, w in zip(found, wanted, strict=True)), (found, wanted)
    mail = "write to kaaa.x(at)mst.example.com then"
    masked = pii.find(table({1: mail}).select("text"), model).select("pii.masked").first()[0]
    assert masked == "write to <EMAIL> then"


def test_gradient_of_the_network():
    model = pii.Model.fresh()
    x, y = pii.training_windows([f"w {k}@a{k}.bc z +1 555 55{k} 5555" for k in range(8)])
    x, y = x[:3, :20], y[:3, :20]

    def loss():
        e = model.emissions(x)
        move = model.p["t"] + model.allowed()
        rows = np.arange(len(x))
        gold = sum(e[rows, t, y[:, t]] for t in range(x.shape[1])) + sum(
            move[y[:, t - 1], y[:, t]] for t in range(1, x.shape[1]))
        return float((model.marginals(e)[0] - gold).mean())
    y[(y[:, :1] > 0) & (y[:, :1] % 2 == 0)[:, :1].repeat(20, 1)] = 0
    grads = model.gradient(x, y)
    for name in ("o", "hf", "hb", "xf", "t"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        model.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at]))


def test_masking():
    text = "x a@b.cd 1.2.3.4"
    assert pii.masked(text, brute.pii(text)) == "x <EMAIL> <IP>"


# ---- toxicity and quality

def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(table, spark):
    rows, marks = {}, []
    for k in range(600):
        bad = k % 4 == 0
        stem = ("blorg", "idiot")[k % 8 == 0]
        rows[k] = prose(k, 60) + (f". You {stem}{'esan'[k % 4:]} {prose(k, 5)}, {stem}y." if bad else ".")
        marks.append((k, 1, int(bad)))
    rows |= {1000: None, 1001: "", 1002: "not an idiot"}
    out = toxicity.toxicity(table(rows), labels_of(spark, marks)).toPandas().set_index("doc_id")
    held = [k for k, _, _ in marks if out.held_out[k]]
    assert 60 < len(held) < 180
    assert np.mean([out.predicted[k] == (k % 4 == 0) for k in held]) > 0.98
    assert out.score.between(0, 1).all() and not out.predicted[[1000, 1001, 1002]].any()
    assert toxicity.toxicity(table(rows).limit(0), labels_of(spark, marks)).count() == 0
    assert toxicity.toxicity(table({1: "you idiot"}), labels_of(spark, [(None, None, None)])).first().predicted == 1


def test_clause_kinds():
    kinds = {text: [k for k, _ in toxicity.clause_matches(text, toxicity.INSULTS)] for text in
             ("what an idiot", "you idiot", "not an idiot", "she said he is an idiot", "i will kill you",
              "i will never kill you", "nothing here")}
    assert list(kinds.values()) == [["plain"], ["aimed"], ["negated"], ["reported"], ["threat"], ["threat_held"], []]


@pytest.mark.parametrize("mark", ["'", "\u2019"])
def test_contractions(mark):
    held = {"you aren{}t an idiot": "negated", "i don{}t kill you": "threat_held", "that isn{}t stupid": "negated",
            "we won{}t ever kill them": "threat_held", "he doesn{}t say you are such an idiot": "aimed",
            "you{}re an idiot": "aimed", "l{}idiot": "plain", "she said you{}re an idiot": "reported"}
    assert {t: [k for k, _ in toxicity.clause_matches(t.format(mark), toxicity.INSULTS)] for t in held} == {
        t: [k] for t, k in held.items()}
    grammar = toxicity.Grammar()
    text = f"You aren{mark}t an idiot."
    assert [k for _, k, _ in toxicity.text_matches(text, grammar, grammar.trigger())] == ["negated"]


def test_quality_on_held_out_documents(table, spark):
    rows, marks = {}, []
    for k in range(500):
        bad = k % 4 == 0
        text = prose(k, 80)
        rows[k] = " ".join(f"{w}{'*%#'[k % 3] * 3}" for w in text.split()) if bad else text
        marks.append((k, int(not bad), 0))
    rows |= {1000: None, 1001: ""}
    out = quality.quality(table(rows), labels_of(spark, marks)).toPandas().set_index("doc_id")
    held = [k for k, _, _ in marks if out.held_out[k]]
    assert np.mean([out.predicted[k] == (k % 4 != 0) for k in held]) > 0.97
    assert out.score.between(0, 1).all() and out.score.notna().all()
    assert quality.quality(table(rows).limit(0), labels_of(spark, marks)).count() == 0
    assert quality.quality(table({1: "a"}), labels_of(spark, [])).first().score == 0.5


# ---- fingerprints

@pytest.mark.parametrize("stretch", [3, 1000])
def test_fingerprints(table, stretch):
    rows = dict(EDGE) | {20 + k: prose(k, 30 + k) for k in range(25)}
    out = {r.doc_id: r for r in fingerprints.fingerprints(table(rows), stretch).collect()}
    ids = sorted(rows, reverse=True)
    for k, i in enumerate(ids):
        text, following = rows[i] or "", rows[ids[(k + 1) % len(ids)]] or ""
        third = len(text) // 3
        changed = text[:len(text) - third] + following[:third]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(text), brute.sha(changed))
        assert out[i].fingerprint == fingerprints.fingerprint(text.encode()).tobytes().hex()
        assert 0 <= out[i].near_next <= 1
    assert out[4].fingerprint == out[6].fingerprint
    one = fingerprints.fingerprints(table({5: "abc def ghi"})).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprints(table({5: "a"}).limit(0)).count() == 0
    assert fingerprints.fingerprints(table([(None, "a b"), (3, "c"), (3, "c"), (None, None)])).count() == 4


def test_collisions_follow_weighted_jaccard():
    a = prose(1, 600)
    b = edited(a, 4, 0.15)
    terms = [fingerprints.term_weights(t.encode()) for t in (a, b)]
    bags = [dict(zip(c.tolist(), w.tolist(), strict=True)) for c, w in terms]
    keys = set(bags[0]) | set(bags[1])
    truth = sum(min(x.get(k, 0) for x in bags) for k in keys) / sum(max(x.get(k, 0) for x in bags) for k in keys)
    marks = [fingerprints.fingerprint(t.encode()) for t in (a, b)]
    assert abs(fingerprints.likeness(*marks, False, False) - truth) < 0.2


@pytest.mark.parametrize("shared", [0, 2_000])
def test_collisions_of_long_texts(shared):
    """Jaccard on the words and word pairs themselves: 20,000 words each, none or a few of them in both."""
    common = [f"c{k}" for k in range(shared)] * 3
    texts = [[f"{side}{k}" for k in range(20_000)] + common for side in "ab"]
    bags = [Counter(w) + Counter(zip(w, w[1:], strict=False)) for w in texts]
    truth = sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())
    marks = [fingerprints.fingerprint(" ".join(w).encode()) for w in texts]
    assert abs(fingerprints.likeness(*marks, False, False) - truth) < (0.11 if shared else 0.04)


def test_estimate_has_no_bias():
    """Terms of equal and unequal weights; the mean over many pairs of bags is the generalised Jaccard similarity."""
    got, truth = [], []
    for k in range(60):
        rng = random.Random(k)
        bags = [{f"w{k}x{n}": w for n, w in enumerate(weights)} for weights in ([1] * 9 + [5] * 9, [2] * 6 + [4] * 12)]
        texts = [[w for w, times in bag.items() for _ in range(times)] for bag in bags]
        for words in texts:
            rng.shuffle(words)
        terms = [Counter(w) + Counter(zip(w, w[1:], strict=False)) for w in texts]
        truth.append(sum((terms[0] & terms[1]).values()) / sum((terms[0] | terms[1]).values()))
        got.append(fingerprints.likeness(*[fingerprints.fingerprint(" ".join(w).encode()) for w in texts], False, False))
    assert abs(np.mean(got) - np.mean(truth)) < 0.03


# ---- token rollups

def test_rollup_is_additive_and_idempotent(table, spark):
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "t"))
    assert rollup.totals().count() == 0
    counts = token_rollup.token_counts(table({1: "a b", 2: None, 3: "c"}, source=lambda i: "s" if i < 3 else None))
    assert rollup.commit("a", token_rollup.changes(counts, "insert"))
    assert not rollup.commit("a", token_rollup.changes(counts, "insert"))
    rollup.commit("b", token_rollup.changes(counts.where("doc_id = 1").withColumn("tokens", F.col("tokens") + 5),
                                            "revise", F.col("tokens") - 5))
    rollup.commit("c", token_rollup.changes(counts.where("doc_id = 3"), "delete"))
    rollup.commit("d", token_rollup.changes(counts.limit(0), "delete"))
    got = {(r.source, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}
    assert got == {("s", "words-v1"): (2, 7), ("s", "pieces-v1"): (2, 7)}


def test_public_vocabulary_counts(table):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    counter = token_rollup.vocabulary_counter(path)
    got = {r.doc_id: r.tokens for r in token_rollup.token_counts(table(EDGE), {"bpe": counter}).collect()}
    plain = tokenizers.Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    assert got == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in EDGE.items()}


# ---- archives

def test_archives_round_trip(spark):
    pages = {1: "<p>a</p>", 2: "<p>a</p>", 3: None, 4: "", 5: "x\r\n\r\nWARC/1.1\r\n\r\ny", 6: "É" * 3000, 7: "z" * 100_000}
    rows = [(i, f"http://h{i}/p q\n?{i}" if i != 6 else None, h, "extra") for i, h in pages.items()]
    frame = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, kind string")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(frame, path)
    records = warc.read_records(spark, path)
    kinds = dict(records.groupBy("kind").count().collect())
    assert kinds["request"] == kinds["metadata"] == 8 and kinds["response"] + kinds["revisit"] == 8
    got = {warc_row.i: warc_row for warc_row in warc.assemble(records.dropDuplicates(["record_id"])).select(
        warc.captured_id(F.col("capture.record_id")).alias("i"), "capture", "request", "metadata",
        warc.captured_id(F.col("capture.refers_to")).alias("to")).collect()}
    for i, html in pages.items():
        raw, row = (html or "").encode(), got[i]
        assert row.capture.digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert row.capture.payload_bytes == len(raw) and f"page-id: {i}" in row.metadata.block
        assert row.request.block.startswith("GET ")
        best = max(k for k, h in pages.items() if (h or "") == (html or ""))
        assert (row.capture.kind, row.to) == (("response", None) if best == i else ("revisit", best))
        assert best != i or row.capture.payload == (html or "")
    empty = scratch_path(spark, "warc-empty")
    warc.write_archives(frame.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_records_are_cut_by_length():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nWARC/1.1\n"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    assert [bytes(b) for _, b in warc.parse_records(gzip.decompress(gzip.compress(record * 2)))] == [block, block]
    with pytest.raises(ValueError):
        list(warc.parse_records(record + b"junk"))


# ---- mixing

def test_mix_targets_and_limits(table):
    rows = dict(EDGE) | {100 + k: prose(k, 5 + k % 40) for k in range(900)}
    docs = table(rows, source=lambda i: None if i % 7 == 0 else f"s{min(i % 11, 4)}")
    out = mixing.mix(docs).toPandas()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    assert abs(out.groupby("source", dropna=False)["target"].first().sum() - 1.5 * sizes.sum()) < 1e-6 * sizes.sum()
    for _, part in out.groupby("source", dropna=False):
        target, largest = part["target"].iloc[0], part["size"].max()
        assert (part["source_size"] == part["size"].sum()).all() and target <= 2 * part["size"].sum() + 1e-6
        assert abs(part["taken"].sum() - target) <= largest
    assert (out["taken"] <= 2 * out["size"]).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert out.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(table({1: None, 2: ""})).agg(F.sum("taken")).first()[0] == 0


def test_boost_prefers_heavier_rows(table):
    rows = {k: "a b c d" for k in range(2000)}
    docs = table(rows, source=lambda i: "s0" if i < 1000 else "s1").withColumn(
        "boost", F.when(F.col("doc_id") % 2 == 0, 1.6).otherwise(0.4))
    out = mixing.mix(docs, weights=(1, 3), share=0.5, boost="boost").where("source = 's0'").toPandas()
    heavy = out[out.doc_id % 2 == 0]["copies"].mean()
    assert heavy > 1.8 * out[out.doc_id % 2 == 1]["copies"].mean()


# ---- suffix arrays

def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1600] = data[100:700]
    padded = np.concatenate([data, np.zeros(200, np.uint8)])
    order = suffix_dedup.suffix_order(padded)
    raw = padded.tobytes()
    assert [raw[i:i + 200] for i in order] == sorted(raw[i:i + 200] for i in range(3000))
    shared = suffix_dedup.common_prefixes(padded, order)
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = 0
        while n < 200 and raw[a + n] == raw[b + n]:
            n += 1
        assert shared[b] == n


@pytest.mark.parametrize("shard", [1500, 2 << 20])
def test_repeats_match_brute_force(table, shard):
    passage, line = prose(41, 60), "the same line of many pages " * 3
    rows = dict(EDGE) | {20 + k: prose(k, 20) + passage[k % 5:] + prose(k + 9, 15) for k in range(30)}
    rows |= {60 + k: prose(k + 70, 40) + line + prose(k + 300, 30) + line for k in range(12)}
    rows |= {80: "a" * 700, 81: "é" * 150 + "x" + "é" * 150, 82: prose(7, 50), 83: prose(7, 50), 84: "ab" * 99 + "a"}
    rows |= {90 + k: edited(prose(12, 90), k, 0.02) for k in range(20)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.remove_repeats(table(rows), shard).collect()}
    assert got == brute.repeats(list(rows.items()))
    assert suffix_dedup.remove_repeats(table(rows).limit(0)).count() == 0


def test_repeated_rows_are_repeats(table):
    out = suffix_dedup.remove_repeats(table([(1, prose(1, 80)), (1, prose(1, 80)), (None, prose(2, 80))])).collect()
    assert sorted(r.n_removed for r in out) == [0, len(prose(1, 80)), len(prose(1, 80))]


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k // 2, lambda k: None if k % 3 else k])
@pytest.mark.parametrize("texts", [lambda k: prose(k, 10 + k % 9), lambda k: prose(1, 12)])
def test_mixing_draws_apart_without_own_ids(table, ids, texts):
    rows = [(ids(k), texts(k)) for k in range(200)]
    got = mixing.mix(table(rows, source=lambda i: "only")).collect()
    sizes = sorted(len(t.split()) for _, t in rows)
    assert len(got) == 200 and sorted(r.size for r in got) == sizes
    target = 1.5 * sum(sizes)
    assert all(abs(r.target - target) < 1e-6 for r in got)
    assert abs(sum(r.taken for r in got) - target) <= max(sizes) and all(r.taken <= 2 * r.size for r in got)


def test_pipeline_stages_with_clashing_names(spark):
    import corpus_pipeline
    rows = [(k, prose(k % 3, 60), "x", f"s{k % 2}", 1, k, "k", "d") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _dropped long, "
                                       "_key string, _doc string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
