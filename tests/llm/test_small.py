"""Mixing, quality, chat, fingerprints and language on small tables."""

import hashlib
from collections import Counter

import numpy as np
from helpers import awkward, none_of
from pyspark.sql import functions as F

from ragmill.llm import chat, chunking, language, mixing, quality


def test_mix_comes_near_targets_and_repeats(spark):
    docs = awkward(spark)
    got = mixing.pareto_mix(docs).collect()
    assert len(got) == docs.count()
    total = sum(r.size for r in got)
    of = {r.source: r for r in got}
    assert abs(sum(r.target for r in of.values()) - 1.5 * total) < 1e-6 * total
    for source, r in of.items():
        mine = [x for x in got if x.source == source]
        assert r.target <= 2 * r.source_size + 1e-9
        assert abs(sum(x.taken for x in mine) - r.target) <= max(x.size for x in mine)
    assert all(r.taken <= 2 * r.size for r in got)
    again = mixing.pareto_mix(docs.repartition(7)).collect()
    assert Counter(got) == Counter(again)
    assert mixing.pareto_mix(none_of(docs)).count() == 0


def test_mix_weights_certain_copies(spark):
    docs = spark.createDataFrame([(i, "a " * 100, "s") for i in range(50)] + [(99, "a " * 100, "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.copies for r in mixing.pareto_mix(docs, doc_weight=F.when(F.col("doc_id") == 99, 100).otherwise(1)).collect()}
    assert got[99] == 2


def test_mix_reaches_targets_with_mixed_lengths(spark):
    rows = [(i, "w " * 9, "a") for i in range(1000)] + [(2000 + i, "w " * 1000, "a") for i in range(9)] + [(3000 + i, "w " * 100, s) for i, s in enumerate(["b"] * 90 + ["c"] * 300 + [None] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weight in (F.length(F.col("size").cast("string")), None, F.when(F.col("size") > 500, 40).otherwise(1)):
        got = mixing.pareto_mix(docs, doc_weight=weight).collect()
        assert len(got) == len(rows)
        for source in ("a", "b", "c", None):
            mine = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
            assert all(r.taken <= 2 * r.size for r in mine)


def test_quality_learns_and_takes_any_text(spark):
    good = [(i, "The quick fox runs over a lazy dog and then some more words follow it. " * (1 + i % 5)) for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!! CHEAP!! " * (2 + i % 7)) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (3, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert sum(got[i].predicted == 1 for i, _ in good) >= 59 and sum(got[i].predicted == 0 for i, _ in bad) >= 19
    clash = quality.fit(docs.withColumns({"q": F.lit(1), "_id": F.lit(2), "quality": F.lit(0)}), labels)
    assert np.array_equal(clash.w, model.w)
    odd = quality.score(awkward(spark), model).collect()
    assert len(odd) == awkward(spark).count() and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (102, 103)}) == 1
    assert quality.score(none_of(docs), model).count() == 0
    only = quality.fit(docs, labels.where("quality = 1"))
    assert quality.score(docs, only).where("predicted = 0").isEmpty()


def test_preference_format(spark):
    t = lambda *xs: [{"role": r, "text": x} for r, x in xs]
    u, a, b = ("user", "hi"), ("assistant", "né"), ("assistant", "no")
    rows = [(1, t(u, a), t(u, b)), (2, t(u, a), t(u, a)), (3, t(u), t(u, a, u)), (4, None, t(u)), (5, t(("user", None), a), t(("user", ""), b)), (6, t(a), t(b)), (6, t(a), t(b))]
    df = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>").withColumn("prompt", F.lit("clash"))
    got = chat.preference_format(df).collect()
    by = {r.pair_id: r for r in got}
    assert len(got) == 7 and [by[i].n_prompt_turns for i in range(1, 7)] == [1, 2, 1, 0, 1, 0]
    assert by[1].prompt == "<|user|>\nhi<|end|>\n"
    for r in got:
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            assert all(text[s.start : s.end] in ("né", "no") for s in spans)
    assert by[2].chosen == by[2].rejected == "" and by[3].chosen == "" and len(by[3].rejected_spans) == 1
    plan = chat.preference_format(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert chat.preference_format(none_of(df)).count() == 0


def test_chunks_cover_the_text_and_fall_back_into_step():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    ends = chunking.chunk_ends(np.frombuffer(data, np.uint8))
    sizes = np.diff(np.concatenate(([0], ends)))
    assert ends[-1] == len(data) and sizes.max() <= 256 and sizes[:-1].min() >= 16
    moved = b"inserted words" + data
    assert chunking.containment(chunking.chunk_set(data), chunking.chunk_set(moved)) > 0.95
    # the gear hash against its definition
    g = chunking.gear_hash(np.frombuffer(data, np.uint8))
    i = 500
    assert g[i] == sum(int(chunking.GEAR[data[i - j]]) << j for j in range(32)) % (1 << 32)


def test_next_and_edited(spark):
    docs = awkward(spark)
    got = chunking.next_and_edited(docs, rows_per_range=7).collect()
    assert len(got) == docs.count()
    texts = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63)), r.text or "") for r in docs.collect())
    texts.sort(key=lambda x: (-x[0], x[1]))
    want = Counter()
    for i, (doc_id, text) in enumerate(texts):
        nxt, h = texts[(i + 1) % len(texts)][1], len(text) // 2
        want[(None if doc_id == -(1 << 63) else doc_id, hashlib.sha256((text[: len(text) - h] + nxt[:h]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    single = chunking.next_and_edited(docs.where("doc_id = 7")).first()
    assert single.near_next == 1.0
    assert chunking.next_and_edited(none_of(docs)).count() == 0


def test_language_fusion(spark):
    docs = spark.createDataFrame([("the cat and the dog are in the house with them", "en"), ("der hund und die katze sind nicht im haus mit ihnen", "de"), (None, "en"), ("x", None)], "text string, lang string")
    model = language.fit_text_model(docs)
    assert model[0] == ["de", "en"]
    page = lambda lang, body: f'<html lang="{lang}"><script>var der = 1</script><p>{body}</p></html>'
    rows = [(i, f"https://a.example.de/x{i}", page("de", "der hund und die katze")) for i in range(8)]
    rows += [(20, "https://a.example.de/y", "<p>?</p>"), (21, "http://b.example.com/en/1", page("xx", "the dog")), (22, None, None), (22, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in language.identify(df, model).collect()}
    assert got[20].lang == "de" and got[21].lang == "en" and got[21].address_lang == "en" and got[0].probability > 0.9
    assert language.identify(df, model).count() == 12 and language.identify(none_of(df), model).count() == 0
    assert language.identify(df, language.fit_text_model(none_of(docs))).where("lang is not null").isEmpty()


def test_language_as_bayes_has_it(spark):
    """Every page against the rule written out: a page alone on its host learns nothing from itself."""
    docs = spark.createDataFrame([("the cat and the dog are in the house with them", "en"), ("der hund und die katze sind nicht im haus mit ihnen", "de"), ("le chat et le chien sont dans la maison", "fr")], "text string, lang string")
    langs, logs = model = language.fit_text_model(docs)
    bodies = ["the dog", "der hund", "le chien est dans", "", "x", "und the"]
    rows = [(i, [f"https://h{i % 4}.a.de/p", f"https://h{i % 3}.b.com/de/x", f"http://alone{i}.org/", None][i % 4], f'<html lang="{["en", "de", "xx"][i % 3]}"><p>{bodies[i % 6]}</p>') for i in range(40)]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    k = len(langs)
    share = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    trust = lambda code, t: np.array([0.0 if code not in langs else np.log(t if code == x else (1 - t) / (k - 1)) for x in langs])
    host = {r[0]: got[r[0]].host for r in rows}
    keys = {i: [h, ".".join(h.split(".")[-2:]), h.split(".")[-1], "all"] for i, h in host.items()}
    evidence = {}
    for i, _, html in rows:
        cells, counts = np.unique(language.trigram_cells(language.visible_text(html)), return_counts=True)
        evidence[i] = logs[:, cells] @ counts * 0.05 + trust(got[i].declared, 0.9) + trust(got[i].address_lang, 0.85)
    for i in host:
        prior = np.full(k, 1 / k)
        for level in (3, 2, 1, 0):
            others = [share(evidence[j]) for j in host if j != i and keys[j][level] == keys[i][level]]
            prior = (sum(others, np.zeros(k)) + 5 * prior) / (len(others) + 5)
        want = share(evidence[i] + np.log(prior))
        assert abs(got[i].probability - want.max()) < 1e-9 and (got[i].lang == langs[int(want.argmax())] or np.sort(want)[-2] > want.max() - 1e-9)


def test_language_bounds(spark):
    assert language.visible_text("a<script>" * 20_000).strip() == "a"
    assert language.visible_text("<p>a<!-- b --> c<i") .split() == ["a", "c"]
    docs = spark.createDataFrame([("some words", f"l{i:04d}") for i in range(300)] + [("more", "zz"), ("more", "zz")], "text string, lang string")
    assert language.fit_text_model(docs, most=3)[0] == ["l0000", "l0001", "zz"]


def chunks_of(data, least=16, normal=64, most=256):
    """Chunks by the rule itself, byte by byte: a running gear hash, a stricter mask up to the normal size."""
    bits = normal.bit_length() - 1
    mask = lambda n: ((1 << n) - 1) << (32 - n)
    out, begin, h, marks = [], 0, 0, []
    for b in data:
        h = ((h << 1) + int(chunking.GEAR[b])) & 0xFFFFFFFF
        marks.append(h)
    while begin < len(data):
        end = min(begin + most, len(data))
        if len(data) - begin > least:
            for p in range(begin + least, end):
                strict = p - begin < normal
                if marks[p - 1] & mask(bits + 1 if strict else bits - 1) == 0:
                    end = p
                    break
        else:
            end = len(data)
        out.append(data[begin:end])
        begin = end
    return out


def test_fingerprints_by_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abcdefghij klmnop\né"), 400)) for _ in range(4)]
    rows = [(i, "".join(pool[k][: int(rng.integers(50, 400))] for k in rng.integers(0, 4, int(rng.integers(0, 9))))) for i in range(40)]
    rows += [(50, rows[7][1]), (51, None), (52, ""), (53, "x" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in chunking.next_and_edited(docs, rows_per_range=5).collect()}
    ordered = sorted(rows, reverse=True)

    def share(a, b):
        a, b = set(a), set(b)
        return sum(len(c) for c in a & b) / sum(map(len, a)) if a and b else float(not a and not b)

    sets = {}
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after = text or "", after or ""
        half = min(len(text) // 2, len(after))
        edited = text[: len(text) - len(text) // 2] + after[:half]
        own, other, next_ = (chunks_of(t.encode()) for t in (text, edited, after))
        assert abs(got[i].near_edited - share(own, other)) < 1e-12 and abs(got[i].near_next - share(own, next_)) < 1e-12
        assert sorted(int(c.split(":")[1], 16) for c in got[i].fingerprint.split()) == sorted(map(len, set(own)))
        sets[i] = frozenset(own)
    for i in sets:
        for j in sets:
            assert (got[i].fingerprint == got[j].fingerprint) == (sets[i] == sets[j])


def test_quality_comes_near_the_exact_optimum(spark):
    """Against Newton's method on the logistic loss of all pairs, with labels that no ranker gets right throughout."""
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(160):
        noise = rng.random()
        words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) + ("!" if rng.random() < noise / 3 else "") for _ in range(int(rng.integers(20, 80)))]
        rows.append((i, " ".join(words)))
        marks.append((i, int(noise + rng.normal() / 5 < 0.6), 0))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    z = np.clip((np.array([quality.features(t) for _, t in rows]) - model.mean) / model.scale, -6, 6)
    z = np.hstack([z, z * z])
    q = np.array([m[1] for m in marks])
    gap = (z[q == 1][:, None] - z[q == 0][None]).reshape(-1, z.shape[1])
    loss = lambda w: np.log1p(np.exp(-gap @ w)).mean() + 0.5e-4 * w @ w
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(gap @ w))
        slope = -(gap * p[:, None]).mean(0) + 1e-4 * w
        bend = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + 1e-4 * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    assert np.abs(slope).max() < 1e-6
    assert loss(w) <= loss(model.w) < loss(w) + 0.03
    right = lambda v: (gap @ v > 0).mean()
    assert right(model.w) > right(w) - 0.02 and right(w) < 1
