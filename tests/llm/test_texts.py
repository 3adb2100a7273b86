"""Pieces, mixing, languages, secrets, classifiers and URL lists on small tables."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
import struct
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushspan.llm import langid, mixing, pieces, quality, secretscan, toxicity, urllists
from tests.llm.helpers import awkward, clashing, docs, rows

SF = "/root/testdata/sf0.001"


def on_duckdb(sql, **tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name, df in tables.items():
        con.register(name, df)
    return con.execute(sql).df()


def same(spark_df, want: pd.DataFrame):
    columns = sorted(want.columns)
    text = lambda f: sorted("|".join("" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
                            for r in f[columns].itertuples(index=False))
    got = spark_df.toPandas()
    assert sorted(got.columns) == columns
    assert text(got) == text(want)


# --- pieces

def odd_texts():
    random.seed(1)
    some = ["", " ", "a", "a ", " a", "a  b", "\n", "\n\na", "a \nb", " \n ", "▁", "a▁b", "a\x00b", "日本 テスト", "😀 x😀", "<s> </s>", "<0x0A>", "x" * 5000]
    return some + ["".join(random.choice("ab \n\t▁é日😀.,<") for _ in range(random.randint(1, 30))) for _ in range(3000)]


def test_pieces_equal_the_library():
    model = pieces.Model(pieces.default_path())
    texts = odd_texts()
    for text, (ids, id_text, decoded) in zip(texts, model.encode(texts)):
        assert ids == model.library.encode(text) and decoded == model.library.decode(ids)
        assert id_text == ",".join(map(str, ids))


def test_spans_cover_the_source():
    model = pieces.Model(pieces.default_path())
    for text in odd_texts():
        ids = model.encode([text])[0][0]
        starts, ends = model.spans(text, ids)
        data, at = text.encode(), 0
        for i, start, end in zip(ids, starts, ends):
            assert start <= at <= end
            at = end
            if model.opens[i] < 0:
                assert data[start:end].decode().replace(" ", "▁") in (model.library.id_to_piece(i), model.library.id_to_piece(i)[1:])
        assert at == len(data)


def double_array(table: dict[bytes, str]) -> bytes:
    """A compiled character map, written the plain way: every node has a block of 256 units."""
    nodes = {b"": 0}
    for key in table:
        for n in range(1, len(key) + 1):
            nodes.setdefault(key[:n], len(nodes))
    base = {key: 256 * (n + 1) for key, n in nodes.items()}
    units, pool, place = [0] * (256 * (len(nodes) + 1)), b"", {}
    where = {b"": 0, **{k: base[k[:-1]] ^ k[-1] for k in nodes if k}}
    for key, value in table.items():
        place[key] = len(pool)
        pool += value.encode() + b"\0"
    for key, at in where.items():
        # The offset leads from the node's own place to its block.
        units[at] = ((at ^ base[key]) << 10) | (key[-1] if key else 0) | (256 if key in table else 0)
        if key in table:
            units[base[key]] = place[key] | 1 << 31
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + pool


def test_character_map_takes_the_longest_prefix_and_keeps_places():
    rules = {"ﬁ".encode(): "fi", b"ab": "X", b"abc": "YZ", "é".encode(): "e", b"-": ""}
    table = pieces.CharacterMap(double_array(rules))
    assert table.longest(b"abcd", 0) == (3, b"YZ") and table.longest(b"abd", 0) == (2, b"X")
    assert table.longest("aé".encode(), 0) == (1, b"a") and table.longest("é".encode(), 0) == (2, b"e")
    model = pieces.Model(pieces.default_path())
    model.map, model.squeeze = table, True
    text, places = model.normalize("  ﬁ-abc é ")
    assert (text, places.tolist()) == ("▁fiYZ▁e", [2, 2, 2, 6, 6, 9, 10, 12])
    assert model.normalize("")[0] == "" and model.normalize("")[1].tolist() == [0] and model.normalize("   ")[0] == ""
    for text in odd_texts() + ["ab", "x abc  ﬁ", "日é"]:
        for squeeze in (False, True):
            model.squeeze = squeeze
            at_once, by_steps = model.normalize(text), model.walk(text.encode())
            assert at_once[0] == by_steps[0] and at_once[1].tolist() == by_steps[1].tolist()
    long = "q" * 300_000 + "abc"
    assert model.normalize(long)[0] == "▁" + "q" * 300_000 + "YZ"


def test_a_wrong_character_map_shows_in_the_spans():
    model = pieces.Model(pieces.default_path())
    ids = model.encode(["grab a cab"])[0][0]
    assert model.spans("grab a cab", ids)[1][-1] == 10
    model.map = pieces.CharacterMap(double_array({b"ab": "X"}))
    with pytest.raises(ValueError):
        model.spans("grab a cab", ids)


def test_encoded_rows(spark):
    table = awkward(spark)
    got = pieces.encoded(clashing(table), ["n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"], ["doc_id"])
    library = pieces.Model(pieces.default_path()).library
    want = []
    for r in table.collect():
        ids = library.encode(r.text or "")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((r.text or "").encode())))
    assert rows(got) == sorted(want, key=repr)
    assert pieces.encoded(table.limit(0), ["ids", "starts", "ends", "decoded"], ["doc_id"]).count() == 0


# --- mixing

def test_mix_equals_sql(spark):
    random.seed(2)
    many = docs(spark, [(i, " ".join(["w"] * random.choice([0, 1, 5, 40, 300])), None, random.choice(["a", "a", "a", "b", "c", "é", "", None])) for i in range(400)])
    for table in (many, awkward(spark), awkward(spark).limit(0), docs(spark, [(1, "", None, "a"), (2, None, None, None)])):
        same(mixing.mix_report(clashing(table)), on_duckdb(mixing.ORACLE, documents=table.toPandas().convert_dtypes()))


def test_mix_comes_near_targets_and_repeats_rows(spark):
    table = docs(spark, [(i, "word " * (1 + i % 9), None, f"s{i % 2}") for i in range(2000)])
    report = mixing.mix_report(table).toPandas()
    got = report.merge(table.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(t=("target", "first"), n=("taken", "sum"))
    assert ((got.t - got.n).abs() <= 9).all() and (report.taken <= 2 * report["size"]).all()
    mixed = mixing.mixed(table).toPandas()
    assert list(mixed.columns) == table.columns
    times = (report.taken // report["size"]).astype(int)
    assert mixed.groupby("doc_id").size().to_dict() == {i: n for i, n in zip(report.doc_id, times) if n}


def test_documents_without_words_are_mixed_twice_at_most(spark):
    table = docs(spark, [(i, "a b" if i % 3 else "", None, "s") for i in range(60)]
                 + [(100 + i, "", None, "t") for i in range(9)] + [(200 + i, "c " * 50, None, "u") for i in range(50)])
    report = mixing.mix_report(table).toPandas()
    copies = mixing.mixed(table).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert copies.max() <= 2 and (report.taken <= 2 * report["size"]).all()
    worded = report[report["size"] > 0].set_index("doc_id")
    assert (copies.reindex(worded.index).fillna(0) == worded.taken // worded["size"]).all()


# --- languages

LANGS = {"en": "the house and the garden with three little windows", "de": "das Haus und der Garten mit drei kleinen Fenstern",
         "fr": "la maison et le jardin avec trois petites fenêtres"}


def test_languages_are_told_apart(spark):
    random.seed(4)
    made = [(i, " ".join(random.choices(LANGS[g].split(), k=12)), g, "s") for i, g in ((i, list(LANGS)[i % 3]) for i in range(150))]
    table = docs(spark, made).union(awkward(spark).where("doc_id > 2"))
    got = {r.doc_id: r for r in langid.identify(clashing(table)).collect()}
    assert all(got[i].lang_pred == g for i, _, g, _ in made if i > 11)
    assert got[3].lang_pred == got[5].lang_pred == got[6].lang_pred == "und" and got[3].score == 0
    kept = langid.in_known_languages(table)
    assert kept.dtypes == table.dtypes and {3, 5, 6}.isdisjoint({r.doc_id for r in kept.collect()} - {i for i, *_ in made})


def test_language_without_labels_is_unknown(spark):
    table = docs(spark, [(1, "some text", None, "s")])
    assert [tuple(r)[2:] for r in langid.identify(table).collect()] == [("und", 0.0)]
    assert langid.identify(table.limit(0)).count() == 0


def test_forward_sum_equals_all_segmentations():
    import math
    import numpy as np

    vocab = langid.vocabulary(pieces.default_path())
    chances = np.random.default_rng(0).random((len(vocab.pieces), 2)) / 1000
    number = {p: i for i, p in enumerate(vocab.pieces)}

    def every(text, lang):
        if not text:
            return 1.0
        total = 0.0
        for n in range(1, len(text) + 1):
            p = chances[number[text[:n]], lang] if text[:n] in number else langid.STRANGE if n == 1 else 0.0
            total += p * every(text[n:], lang) if p else 0.0
        return total

    words = ["▁the", "▁garden", "▁日ü", "▁a"]
    got = langid.log_chances(words, langid._with_strange(chances), vocab)
    for word, logs in zip(words, got):
        assert [math.log(every(word, lang)) for lang in (0, 1)] == pytest.approx(list(logs))
    for word in ["the", "日ü", "", "ab" * 9]:
        alone = langid.long_log_chances(word, langid._with_strange(chances), vocab)
        assert [math.log(every("▁" + word, lang)) for lang in (0, 1)] == pytest.approx(list(alone))
    used = langid.expected_counts(["▁the"], np.array([2.0]), langid._with_strange(chances)[:, 0], vocab)
    assert sum(n * len(vocab.pieces[i]) for i, n in enumerate(used)) == pytest.approx(8)


def test_long_words_are_summed_whole(monkeypatch):
    import numpy as np

    vocab = langid.vocabulary(pieces.default_path())
    table = langid._with_strange(np.random.default_rng(1).random((len(vocab.pieces), 3)) / 1000)
    word = "".join(random.Random(2).choices(["stein", "house", "日", "ing", "q9"], k=40))
    whole = langid.log_chances(["▁" + word], table, vocab)[0]
    assert langid.long_log_chances(word, table, vocab) == pytest.approx(whole)
    monkeypatch.setattr(langid, "STRETCH", 7)
    assert langid.long_log_chances(word, table, vocab) == pytest.approx(whole)
    scorer = langid.Scorer(langid.Model(["a", "b", "c"], table[:-2], pieces.default_path()))
    both = scorer.totals([f"{word} the", "", word, "the"])
    assert both[0] == pytest.approx(both[2] + both[3]) and both[2] == pytest.approx(whole) and not both[1].any()


def test_learning_sums_long_words_whole(monkeypatch):
    import numpy as np

    vocab = langid.vocabulary(pieces.default_path())
    chance = langid._with_strange(np.random.default_rng(3).random((len(vocab.pieces), 1)) / 1000)[:, 0]
    for stretch in (1 << 14, 7):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        for n in (0, 1, 8, 40):
            word = "".join(random.Random(n).choices(["stein", "house", "日", "ing", "q9"], k=n))
            whole = langid.expected_counts(["▁" + word], np.array([1.0]), chance, vocab)
            assert langid.long_expected_counts(word, chance, vocab) == pytest.approx(whole)
    monkeypatch.setattr(langid, "STRETCH", 1 << 14)
    word = "donaudampfschiff" * 5_000
    used = langid.long_expected_counts(word, chance, vocab)
    assert sum(n * len(vocab.pieces[i]) for i, n in enumerate(used)) == pytest.approx(len(word) + 1)


def test_learned_chances_count_long_words(spark):
    """A language whose words are all long learns the same pieces as plain counts over whole words."""
    import numpy as np

    word = "donaudampfschifffahrtsgesellschaft"
    table = docs(spark, [(i, f"{word} {word}", "de", "s") for i in range(8)])
    model = langid.fit(table)
    vocab = langid.vocabulary(pieces.default_path())
    chance = np.full((len(vocab.pieces), 1), 1 / len(vocab.pieces))
    for _ in range(langid.ROUNDS):
        used = langid.expected_counts(["▁" + word], np.array([1.0]), langid._with_strange(chance)[:, 0], vocab)
        n = 2 * sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(8)) * used
        own, common = (n + 1e-9) / (n + 1e-9).sum(), (n + 0.1) / (n + 0.1).sum()
        chance = np.float32((1 - langid.SHARED) * own + langid.SHARED * common).astype(float)[:, None]
    assert model.chances[:, 0] == pytest.approx(chance[:, 0], rel=1e-4)


# --- classifiers

@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_learn_from_labels_alone(spark, module, label):
    random.seed(6)
    words = [f"{a}{b}" for a in ("mor", "lin", "tas", "vek") for b in ("en", "ula", "ix", "ord")]

    def text(bad):
        some = random.choices(words, k=60)
        if bad and label == "toxic":
            some[random.randrange(60)] = "wretchedscum"
        return " ".join(some) if not bad or label == "toxic" else " ".join(w for w in some for _ in range(8))

    flags = [random.random() < 0.3 for _ in range(500)]
    table = docs(spark, [(i, text(b), "en", "s") for i, b in enumerate(flags)])
    table = table.union(docs(spark, [(9001, None, None, None), (9002, "", None, None), (9003, "w " * 50_000, None, None)]))
    value = (lambda b: int(b)) if label == "toxic" else (lambda b: int(not b))
    labels = spark.createDataFrame([(i, value(b), value(b)) for i, b in enumerate(flags)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in module.classify(clashing(table), labels).collect()}
    held = [i for i in range(500) if got[i].held_out]
    assert 50 < len(held) < 200 and sum(got[i].predicted == value(flags[i]) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and got[9001].score == got[9002].score


def test_attention_equals_plain_code(monkeypatch):
    """Scores by loops over documents, passages and words; slopes by differences of a loss written out."""
    import math
    import numpy as np

    monkeypatch.setattr(quality, "BUCKETS", 64)
    draw = random.Random(21)
    texts = [" ".join(draw.choice("alder birch cedar elm fir 12 , Oak\n".split(" ")) for _ in range(n)) for n in (130, 1, 0, 50, 48, 97)]
    x, owner, words, buckets = quality.passages(texts)
    assert np.bincount(owner).tolist() == [max(1, -(-len(t.split()) // quality.PASSAGE)) for t in texts]
    assert words.sum() == len(buckets) == sum(len(t.split()) for t in texts) and words[list(owner).index(2)] == 0
    number = {}
    for word, at in zip((w for t in texts for w in t.split()), buckets.tolist()):
        assert number.setdefault(word, at) == at and 0 <= at < 64
    model = quality.Attention(x.mean(axis=0), x.std(axis=0) + 1e-3)
    random_state = np.random.default_rng(5)
    for name, value in model.p.items():
        model.p[name] = random_state.standard_normal(value.shape) / 3
    y, weight = np.array([1.0, 0, 1, 0, 0, 1]), np.array([1.0, 2, 1, 2, 2, 1])

    def plain():
        p, out, at = {k: v.tolist() for k, v in model.p.items()}, [], 0
        passages = []
        for row, n in zip(x, words):
            z = [min(5, max(-5, (a - b) / c)) for a, b, c in zip(row, model.mean, model.spread)]
            mine = buckets[at:at + n].tolist()
            at += n
            h = [math.tanh(sum(z[i] * p["E"][i][j] for i in range(len(z))) + p["e"][j] + sum(p["W"][b][j] for b in mine) / max(1, len(mine)))
                 for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[j] * p["V"][j][k] for j in range(len(h)))) / (1 + math.exp(-sum(h[j] * p["U"][j][k] for j in range(len(h)))))
                    for k in range(quality.GATE)]
            passages.append((h, math.exp(sum(g * w for g, w in zip(gate, p["w"])))))
        for d in range(len(texts)):
            mine = [q for q, o in zip(passages, owner) if o == d]
            total = sum(a for _, a in mine)
            out.append(1 / (1 + math.exp(-p["d"][0] - sum(a / total * sum(u * c for u, c in zip(h, p["c"])) for h, a in mine))))
        return out

    starts = np.searchsorted(owner, np.arange(len(texts)))
    assert model.forward(x, starts, owner, words, buckets)[-1].tolist() == pytest.approx(plain())
    assert model.score(texts).tolist() == pytest.approx(plain())

    def loss():
        return sum(w * -math.log(s if t else 1 - s) for s, t, w in zip(plain(), y, weight)) / weight.sum()

    slopes = model.slopes(x, starts, owner, words, buckets, y, weight)
    for name, slope in slopes.items():
        for place in draw.sample(list(np.ndindex(slope.shape)), min(6, slope.size)) + ([(int(buckets[0]), 3)] if name == "W" else []):
            kept, found = model.p[name][place], []
            for by in (1e-5, -1e-5):
                model.p[name][place] = kept + by
                found.append(loss())
            model.p[name][place] = kept
            assert slope[place] == pytest.approx((found[0] - found[1]) / 2e-5, rel=1e-4, abs=1e-9), (name, place)


def test_fitted_passages_are_spread_evenly():
    import numpy as np

    owner = np.repeat([0, 1, 2, 3], [1, 16, 100, 17])
    taken = quality.spread_out(owner, 16)
    assert np.bincount(owner[taken]).tolist() == [1, 16, 16, 16]
    assert np.diff(np.flatnonzero(taken[17:117])).max() <= 7 and taken[17]
    assert quality.spread_out(np.zeros(0, np.int64), 16).tolist() == []


def test_quality_tells_words_of_equal_shape_apart(spark):
    random.seed(17)
    made = [(i, " ".join(random.choice([["lorem", "amber", "field"], ["vodka", "crass", "spams"]][i % 2] + ["plain", "words"]) for _ in range(150)), "en", "a")
            for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = quality.classify(docs(spark, made), labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.held_out)


def test_toxicity_weighs_every_supported_n_gram(spark):
    import numpy as np

    random.seed(13)
    made = [(i, " ".join(f"{'ab'[i % 2]}{random.randrange(3000):04d}" for _ in range(150)), "en", "a") for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i, *_ in made], "doc_id long, toxic int")
    table = docs(spark, made)
    model = toxicity.fit(table, labels)
    sample = [text for i, text, *_ in made if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD_OUT]
    what = np.concatenate([np.unique(toxicity.grams(t)) for t in sample])
    want = np.flatnonzero(np.bincount(what, minlength=toxicity.BUCKETS) >= toxicity.SUPPORT)
    assert len(want) > 6_000 and model.buckets.tolist() == want.tolist()
    got = toxicity.classify(table, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_without_labels_or_rows(spark, module):
    table = awkward(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r.score for r in module.classify(table, labels).collect()}) == 1
    assert module.classify(table.limit(0), labels).count() == 0


def test_toxicity_fit_equals_plain_code(spark, monkeypatch):
    """Ratios by plain counts of n-grams, and no slope left at the weights found, by a loss written out."""
    import math

    monkeypatch.setattr(toxicity, "SUPPORT", 2)
    random.seed(31)
    words = [["good", "calm", "nice", "day", "sun"], ["vile", "scum", "rage", "day", "hate"]]
    given = [(i, " ".join(random.choice(words[i % 2]) for _ in range(6)), None, None) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, given), labels)
    seen = [(t, y) for (i, t, _, _), y in zip(given, (i % 2 for i in range(60))) if zlib.crc32(str(i).encode()) % 4 != 2]

    def plain_grams(text):
        text = f" {' '.join(text.lower().split())} "
        return {text[i:i + n] for n in (4, 5, 6) for i in range(len(text) - n + 1)}

    def bucket(gram):
        rolled = 0
        for c in gram:
            rolled = (rolled * 0x100000001B3 + ord(c) * 0x9E3779B97F4A7C15) % 2**64
        return ((rolled ^ rolled >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> 44
    sets = [({bucket(g) for g in plain_grams(t)}, y) for t, y in seen]
    totals = [sum(y == k for _, y in sets) for k in (0, 1)]
    counts = {b: [sum(b in s for s, y in sets if y == k) for k in (0, 1)] for b in set().union(*(s for s, _ in sets))}
    ratio = {b: math.log((c[1] + 1) / (totals[1] + 2)) - math.log((c[0] + 1) / (totals[0] + 2)) for b, c in counts.items() if sum(c) >= 2}
    assert sorted(ratio) == model.buckets.tolist()
    beta = {b: w / ratio[b] if ratio[b] else 0.0 for b, w in zip(model.buckets.tolist(), model.weights)}
    errors = [(s, 1 / (1 + math.exp(-model.intercept - sum(ratio[b] * beta[b] for b in s if b in beta))) - y) for s, y in sets]
    slopes = [sum(e for s, e in errors if b in s) * ratio[b] / len(sets) + toxicity.RIDGE * beta[b] for b in beta]
    at_zero = [sum(0.5 - y for s, y in sets if b in s) * ratio[b] / len(sets) for b in beta]
    assert max(map(abs, slopes)) < 0.02 * max(map(abs, at_zero)) and abs(sum(e for _, e in errors)) / len(sets) < 0.01


def test_features_are_packed_whole():
    import numpy as np

    for values in ([], [0], [5, 6, 70_000, 70_001, 1 << 20], list(range(0, 1 << 20, 65_535)), [0xFFFE, 2 * 0xFFFF]):
        assert toxicity.unpack(toxicity.pack(np.array(values, np.int64))).tolist() == values


# --- secrets

def secret_docs(spark):
    random.seed(8)
    key = lambda: "AKIA" + "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    made = []
    for i in range(120):
        made.append((i, f"we deploy with {key()} on the host", None, "app/main"))
        made.append((1000 + i, f"please pay card {random.randrange(10**15, 10**16)} of the order", None, "app/main"))
        made.append((2000 + i, f"set password={random.getrandbits(72):018x}; done", None, "docs/test/x"))
    return docs(spark, made)


def test_secrets_are_told_from_other_numbers(spark):
    table = secret_docs(spark).union(awkward(spark))
    got = secretscan.scan(clashing(table)).toPandas()
    of = got.set_index("doc_id").secret
    assert of[[i for i in range(12, 120)]].all() and of[[2000 + i for i in range(120)]].all() and not of[[1000 + i for i in range(120)]].any()
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in got[got.doc_id > 11].itertuples():
        value = texts[r.doc_id][r.start:r.start + r.length]
        assert hashlib.sha256(value.encode()).hexdigest() == r.value_sha256
    clean = secretscan.redacted(table)
    assert clean.dtypes == table.dtypes and clean.count() == table.count()
    after = {r.doc_id: r for r in clean.collect()}
    assert after[15].text == "we deploy with <SECRET> on the host" and after[2003].text == "set password=<SECRET>; done"
    assert after[1007].text == texts[1007] and after[15].n_chars == len(after[15].text) and after[3].text is None
    assert after[7].text == texts[7]


def test_secret_offsets_of_many_candidates(spark):
    text = " ".join(f"id{i:016d} é" for i in range(3000))
    got = secretscan.candidates(docs(spark, [(1, text, None, None)])).collect()
    assert len(got) == 3000 and all(text[r.start:r.start + len(r.hit)] == r.hit for r in got)
    assert secretscan.scan(docs(spark, [])).count() == 0 and secretscan.redacted(docs(spark, [])).count() == 0


def test_secrets_in_common_leaks_are_candidates(spark):
    key, long, hexes = "AKIA" + "Q7" * 8, "aB3/" * 10, "0f" * 16
    leaks = [(f"AWS_ACCESS_KEY_ID={key}", key), (f"AWS_SECRET_ACCESS_KEY={long}", long), (f"private_key={hexes}", hexes),
             ("secret_key=abcd1234efgh5678", "abcd1234efgh5678"), (f"https://x.example.com/v1?key=AIza{hexes}", f"AIza{hexes}"),
             ("password         = hunter2abc", "hunter2abc"), ("passwd => s3cretpw99", "s3cretpw99"), ("password: abc1234", "abc1234"),
             ("postgres://user:pa55word@db.example.com/x", "pa55word"), (f"id={key}", key), (f":/{key}", f"/{key}"),
             (f"Authorization: Bearer {hexes}", hexes), ("auth:\n  password: hunter2abc", "hunter2abc"), ("{\"api_key\": \"zz9\"}", "zz9"),
             ("c2VjcmV0a2V5c2VjcmV0a2V5MTIzkey== x", "c2VjcmV0a2V5c2VjcmV0a2V5MTIzkey==")]
    table = docs(spark, [(i, f"see {text} here", None, "app") for i, (text, _) in enumerate(leaks)])
    got = secretscan.scan(table).collect()
    for i, (text, value) in enumerate(leaks):
        hashes = {r.value_sha256 for r in got if r.doc_id == i}
        assert hashlib.sha256(value.encode()).hexdigest() in hashes, text
    trained = secretscan.redacted(secret_docs(spark).union(docs(spark, [(9000 + i, f"see {text} here", None, "app") for i, (text, _) in enumerate(leaks[:4])] + [
        (9100 + i, f"{name}: {word} of note", None, "app") for i, (name, word) in enumerate(zip(["author", "key", "passage", "monkey"] * 5, ["the", "Anna", "short", "wild"] * 5))])))
    after = {r.doc_id: r.text for r in trained.collect() if r.doc_id >= 9000}
    assert [i for i in range(4) if "<SECRET>" not in after[9000 + i]] == [] and [i for i in range(20) if "<SECRET>" in after[9100 + i]] == []


def test_long_words_of_names_are_read_once(spark):
    text = "key" * 60_000 + " " + "a." * 90_000 + " password=hunter2abc"
    assert [r.hit for r in secretscan.candidates(docs(spark, [(1, text, None, None)])).collect()] == ["password=hunter2abc"]


def test_paths_without_a_digit_are_read_once(spark):
    import time

    text = "a/" * 500_000
    table = docs(spark, [(1, text, None, None), (2, text + "x/9 password=hunter2abc", None, None)])
    secretscan.candidates(docs(spark, [(1, "warm up", None, None)])).collect()
    began = time.perf_counter()
    assert [r.hit for r in secretscan.candidates(table.where("doc_id = 1")).collect()] == []
    assert time.perf_counter() - began < 5
    assert [r.hit for r in secretscan.candidates(table.where("doc_id = 2")).collect()] == [text + "x/9", "password=hunter2abc"]


def test_values_end_at_delimiters_outside_quotes(spark):
    cases = [("password=a1b2c3,user=b", "a1b2c3"), ("?key=X1y2z3&page=2", "X1y2z3"), ("(token=abc123)", "abc123"), ("[secret: q9w8]", "q9w8"),
             ("{pwd=zz99}", "zz99"), ("pass=hunter2;next", "hunter2"), ("password='a,b;c&d)'", "a,b;c&d)"), ('"api_key": "k1,]k2"', "k1,]k2")]
    got = {r.doc_id: r for r in secretscan.scan(docs(spark, [(i, t, None, None) for i, (t, _) in enumerate(cases)])).collect()}
    for i, (text, value) in enumerate(cases):
        r = got[i]
        assert text[r.start:r.start + r.length] == value and r.value_sha256 == hashlib.sha256(value.encode()).hexdigest(), text


def test_a_rare_label_is_learned_from(spark, monkeypatch):
    """One label's findings do not crowd out the other's, and count as many as they stand for."""
    monkeypatch.setattr(secretscan, "SAMPLE", 15)
    random.seed(21)
    made = [(i, f"order {random.randrange(10**15, 10**16)} here", None, "app") for i in range(600)]
    made += [(10_000 + i, f"password=x{random.getrandbits(64):016x}9 here", None, "app") for i in range(20)]
    got = secretscan.scan(docs(spark, made)).toPandas().set_index("doc_id").secret
    assert got[[10_000 + i for i in range(20)]].all() and not got[list(range(600))].any()


# --- URL lists

def test_url_lists_equal_sql(spark):
    pages = [(1, "http://User@A.b.Example.com:80/x/y?q"), (1, "http://User@A.b.Example.com:80/x/y?q"), (2, None), (3, ""), (4, "no url"),
             (5, "https://example.com"), (6, "https://b.example.com/x"), (7, "http://localhost/z"), (8, "https://[::1]/a")]
    pages += [(100 + i, f"http://hot.example.net/{i % 5}/p") for i in range(300)]
    random.seed(9)
    kinds = ["error", "signup", "click", "purchase", "view"]
    events = [(i, datetime(2023, 12, 30) + timedelta(hours=random.randrange(800)), random.choice([1, 5, 6, 7, 100, 101, 102]), random.choice(kinds)) for i in range(400)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    e = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string")
    want = on_duckdb(urllists.ORACLE, pages=pd.DataFrame(pages, columns=["page_id", "url"]), events=pd.DataFrame(events, columns=["event_id", "ts", "user_id", "event_type"]))
    same(urllists.as_of(urllists.captures_of(clashing(p)), urllists.entries_of(e, p)), want)
    assert want.blocked.any() and not want.blocked.all()
    nothing = urllists.as_of(urllists.captures_of(p), urllists.entries_of(e.limit(0), p)).collect()
    assert not any(r.blocked for r in nothing) and len(nothing) == len(set(pages))
    assert urllists.as_of(urllists.captures_of(p.limit(0)), urllists.entries_of(e, p)).count() == 0


def plain_copies(texts, similarity=0.8):
    """{id: smallest id reachable by links} over all pairs, from sets of five lower-case words."""
    def shingles(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and both >= similarity * (len(sets[i]) + len(sets[j]) - both)):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data")
def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in langid.identify(table).collect() if r.lang_pred != "und" and r.score >= 0.5}
    first = table.where(F.col("doc_id").isin(list(known)))
    groups = set(plain_copies({r.doc_id: r.text for r in first.collect()}).values())
    texts = {r.doc_id: r for r in secretscan.redacted(first.where(F.col("doc_id").isin(list(groups)))).collect()}
    library = pieces.Model(pieces.default_path()).library
    mixed = mixing.mix_report(spark.createDataFrame(list(texts.values()), table.schema)).toPandas()
    times = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixed.itertuples()}
    assert got.groupby("doc_id").size().to_dict() == {i: n for i, n in times.items() if n}
    for r in got.itertuples():
        assert list(r.ids) == library.encode(texts[r.doc_id].text)
