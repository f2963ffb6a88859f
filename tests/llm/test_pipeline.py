"""The stages of the corpus pipeline, each against a plain version on its own input."""

import corpus_pipeline
import test_decontamination
import test_line_dedup
import test_ngram_join
from llm_fixtures import COLUMNS, edge_rows
from postsieve.llm.queries import tokenizer_file
from postsieve.session import stage


def rows_of(frame):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in frame.collect()), key=repr)


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame(edge_rows(), COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(test_decontamination.ITEMS, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns

    def run(name):
        nonlocal docs
        docs = stage(steps[name](spark, docs, sf))
        if name != "sequence_packing":
            assert docs.columns == columns
        return docs

    want = [r[:5] for r in edge_rows() if r[1] and any(c.isalpha() for c in r[1])]
    assert rows_of(run("language_id")) == sorted(want, key=repr)

    plain = test_line_dedup.all_pairs([r[:2] for r in want])
    kept = sorted(((i, t) for i, _, n, t in plain if n == 0 or t.strip()), key=repr)
    got = rows_of(run("line_dedup"))
    assert [r[:2] for r in got] == kept and len(kept) < len(want)
    assert all(r[4] is None or r[4] == len(r[1]) or (r[0], r[1]) in {w[:2] for w in want} for r in got)

    classes, _ = test_ngram_join.plain([r[:2] for r in got])
    firsts = {i for i, _, c in classes if i is not None and i == c}
    want = {r for r in got if r[0] in firsts} | {r for r in got if r[0] is None}
    found = rows_of(run("ngram_jaccard_join"))
    assert {r[:2] for r in found} == {r[:2] for r in want} and len(found) == len({r[:2] for r in found})

    clean = [r for r in found if not test_decontamination.plain(r[1], test_decontamination.ITEMS)[1]]
    dirty = {r[0] for r in found if r not in clean}
    assert rows_of(run("benchmark_decontamination")) == [r for r in clean if r[0] is None or r[0] not in dirty] and dirty

    pieces = run("sequence_packing").collect()
    texts = [r for r in clean if r[0] is None or r[0] not in dirty]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    tokens = sum(len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in texts)
    assert sum(p.length for p in pieces) == tokens


def test_empty_corpus(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_columns_with_clashing_names_are_kept(spark, tmp_path):
    sf = str(tmp_path)
    extra = "n_removed string, n_lines string, score double, lang_pred string, _digest string, digest string, _language string, language string, component_id long, spans string, key string, made int, deleted int"
    values = ("mine", "too", 5.0, "xx", "a", "b", "c", "d", 77, "e", "f", 8, 9)
    long = test_ngram_join.passage(1, 60_000)
    rows = [r[:5] + values for r in edge_rows()] + [(900, long, "en", "s", 1, *values), (901, long, "en", "s", 1, *values)]
    schema = COLUMNS.split(", token")[0] + ", " + extra
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(test_decontamination.ITEMS, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, sf))
        assert docs.columns == columns, name
        kept = docs.collect()
        assert kept and all(tuple(r)[5:] == values for r in kept), name
        assert any(r.doc_id == 900 for r in kept)
    assert not any(r.doc_id == 901 for r in kept)
