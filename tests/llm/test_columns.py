"""Columns of the caller's with the names that operators work with pass through them."""

import pytest

from tessera.llm import licenses, mixing, quality_rules, simhash, suffix_dedup

#: Names that the operators use inside, or have used.
NAMES = "_row _n _f _p0 _e1 _rate _copies _copy _fence _fence2 _ids _left _r0 _keep _id _text _place _part _bytes _removed _spans _kept _n_bytes _words _lines _windows _any _at _lang _source _group key start bucket n m0 c00 l00 z0 d2 det distance2 f_length f_word part a b c fp anchor component rank score kept rate copies n_words n_removed licenses own0".split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = [" ".join(f"word{i} of{i * 7}" for i in range(30)), "other words that stand here, released under the MIT License. " * 3, None, "", "the same text twice " * 20, "the same text twice " * 20]
    rows = [(k, t, "en", "s", 1, *[f"{n}{k}" for n in NAMES]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")


STAGES = {
    "quality_rules": lambda d, _: quality_rules.quality_rules(d),
    "simhash_dedup": lambda d, _: simhash.simhash_dedup(d),
    "suffix_dedup": lambda d, _: suffix_dedup.suffix_dedup(d),
    "mix": lambda d, labels: mixing.mix(d, labels),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_all_columns(docs, labels, name):
    out = STAGES[name](docs, labels)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
    assert STAGES[name](docs.limit(0), labels).count() == 0


ADDING = {
    "quality_scores": (lambda d, _: quality_rules.quality_scores(d), quality_rules.ADDED),
    "mixing_rates": (lambda d, labels: mixing.mixing_rates(d, labels), mixing.ADDED),
    "license_scan": (lambda d, _: licenses.license_scan(d), licenses.ADDED),
    "remove_repeats": (lambda d, _: suffix_dedup.remove_repeats(d), suffix_dedup.ADDED),
}


@pytest.mark.parametrize("name", ADDING)
def test_operators_add_to_all_columns(docs, labels, name):
    f, added = ADDING[name]
    out = f(docs, labels)
    assert out.columns == [c for c in docs.columns if c != "text" and c not in added] + list(added)
    rows = out.collect()
    assert len(rows) == 6 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES if n not in added)
