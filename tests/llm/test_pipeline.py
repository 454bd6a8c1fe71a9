"""The corpus pipeline against a plain version of each stage, on its own input."""

import random

import numpy as np
import pytest
import test_byte_bpe
import test_quality_rules
import test_simhash
import test_suffix_dedup

import corpus_pipeline as p
from tessera.llm import mixing, quality_rules
from tessera.session import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "lu", "mer", "no", "pi") for b in ("ra", "sen", "tik", "vo", "wen", "xa", "zu")]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows, labels = [], []
    for i in range(160):
        text = [rng.choice(words) for _ in range(rng.randint(25, 120))]
        text += [f"{rng.choice(('nice', 'vile', 'dull'))}{rng.randint(0, 30)}" for _ in range(15)]
        if i % 11 == 0:
            text = [w + "###" for w in text]
        text = " ".join(text) + (" " + passage if i % 7 == 0 else "") + f" end{i} of{i} this{i}"
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        if i % 5 == 0:
            rows.append((1000 + i, text, "en", f"s{i % 2}", len(text)))
        if i % 3:
            labels.append((i, int("vile" not in text), int(text.count("vile") > 5)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0), (2002, "few words", "en", None, 9)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_each_stage_equals_its_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before, outputs = docs, {}
    for name, stage in p.STAGES:
        outputs[name] = before, cut(stage(spark, before, sf_dir))
        before = outputs[name][1]
    for name, _ in p.STAGES[:-1]:
        assert outputs[name][1].columns == columns

    given, kept = outputs["quality_rules"]
    judged = {r.doc_id: r for r in quality_rules.quality_scores(given).collect()}
    for d, text in pairs(given):
        n, _, _, _, repeats = test_quality_rules.brute_stats(text)
        assert judged[d].base_failed == (n < 20 or 100 * repeats > 30 * n)
    assert sorted(pairs(kept)) == sorted((d, t) for d, t in pairs(given) if judged[d].kept)
    assert 0 < kept.count() < given.count() and not any("###" in t for _, t in pairs(kept))

    given, kept = outputs["simhash_near_dedup"]
    stay = {c for *_, c in test_simhash.brute(pairs(given))}
    assert sorted(pairs(kept)) == sorted((d, t) for d, t in pairs(given) if d in stay) and max(stay) < 1000

    given, cleaned = outputs["suffix_dedup"]
    want = {d: kept.decode(errors="ignore") for _, d, _, _, _, kept in test_suffix_dedup.brute(pairs(given))}
    assert dict(pairs(cleaned)) == want and dict(pairs(given)) != want

    given, mixed = outputs["mixing"]
    rates = mixing.mixing_rates(given, spark.read.parquet(f"{sf_dir}/labels.parquet"), p.SCALE, relative=True).toPandas()
    share = rates[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    w = rates.n_words.to_numpy() / rates.n_words.sum()
    goal = (w @ share) * [p.SCALE.get(d, 1.0) for d in mixing.DOMAINS]
    assert np.abs((w * rates.rate.to_numpy()) @ share - goal / goal.sum()).max() < 1e-3
    assert sorted(pairs(mixed)) == sorted(x for x in pairs(given) for _ in range(int(rates.copies[rates.doc_id == x[0]].iloc[0])))

    given, encoded = outputs["byte_bpe"]
    got = sorted((r.doc_id, list(r.ids)) for r in encoded.collect())
    assert got == sorted((d, test_byte_bpe.LIBRARY.encode_ordinary(t or "")) for d, t in pairs(given))
    assert sorted((r.doc_id, list(r.ids)) for r in p.run(spark, sf_dir).collect()) == got
