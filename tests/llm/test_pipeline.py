"""The pipeline's stages, each against brute force on what the stage before has kept."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import brute as without_lines
from tests.llm.test_simhash import brute as groups
from tests.llm.test_simhash import plain

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns, states = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            states.append({r.doc_id: r.text for r in docs.collect()})
    start, known, deduped, single, clean = states
    assert known.items() <= start.items() and all(any(map(str.isalpha, t)) for t in known.values())
    assert len(known) > 0.95 * sum(any(map(str.isalpha, t or "")) for t in start.values())
    assert deduped == {i: kept for i, (_, _, kept) in without_lines(known).items()}
    component = groups({i: plain(t) for i, t in deduped.items()})
    assert single == {i: t for i, t in deduped.items() if component[i] == i}
    assert clean == {i: t for i, t in single.items() if not contaminated(t, items)[1]}
    assert len(clean) < len(single) < len(deduped)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = docs.collect()
    for doc, text in clean.items():
        own = b"".join(p.ids for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start))
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert own == b"".join(i.to_bytes(4, "little") for i in ids)
    ran = corpus_pipeline.run(spark, FOLDER)
    key = lambda p: (p.doc_id, p.start)
    assert [(*key(p), p.ids) for p in sorted(ran.collect(), key=key)] == [(*key(p), p.ids) for p in sorted(pieces, key=key)]
