"""Each stage of the pipeline against brute force on what its predecessor kept."""

from test_text_operators import line_rows, linked_groups, toxic_rows, words

import corpus_pipeline
from webweft.llm import jaccard_join, mixing


def test_stages(spark, tmp_path):
    rows = [(i, t + f"\nA line that every {'other' if i % 2 else 'third'} document has", y) for i, t, y in toxic_rows(120)]
    base = words(60, 4242).split()
    rows += [(1000 + i, " ".join([*base[:30], f"x{i}", *base[31:]]), 0) for i in range(4)] + [(2000, "", 0), (2001, None, 0), (2002, words(3000, 3, 9000), 0)]
    documents = [(i, t, "en", None if i % 7 == 0 else f"src{i % 4}", len(t or "")) for i, t, _ in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    steps, docs = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        steps.append([tuple(r) for r in docs.collect()])
        assert n == 4 or docs.columns == corpus_pipeline.COLUMNS
    clean, lines, groups, mixed, packed = steps

    toxic = {i for i, _, y in rows if y}
    assert len({r[0] for r in clean} & toxic) <= 0.1 * len(toxic)
    assert len({r[0] for r in clean} - toxic) >= 0.97 * (len(rows) - len(toxic))
    want = {d: n for d, _, n, _ in line_rows([(r[0], r[1]) for r in clean])}
    had = {r[0]: (r[1] or "").count("\n") + 1 for r in clean}
    assert {str(r[0]) for r in lines} == set(want)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in lines)
    assert sum(had.values()) - sum(want.values()) >= sum((r[1] or "").count("\n") + (1 if r[1] else 0) for r in lines) - len(lines)
    least = {key for key, _, component in linked_groups([(r[0], r[1]) for r in lines]) if key == component}
    assert {str(r[0]) for r in groups} == least and len({r[0] for r in groups if 1000 <= r[0] < 1004}) == 1
    assert sorted(map(repr, mixed)) == sorted(map(repr, groups))
    placed = {r["doc_id"]: (r["mix_slot"], r["mix_start"]) for r in mixing.mix(spark.createDataFrame(groups, schema)).where("mix_piece = 0").collect()}
    parts = sorted((tmp_path / "stage3").glob("part-*"))
    order = [r[0] for p in parts for r in spark.read.parquet(str(p)).select("doc_id").collect()]
    assert [placed[i] for i in order] == sorted(placed.values())
    assert {r[0] for r in packed} == {r[0] for r in mixed}
    used = {}
    for _, _, _, length, _, sequence, offset in packed:
        used.setdefault(sequence, []).append((offset, length))
    assert all(sum(n for _, n in v) <= 1024 and [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] for v in used.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
    assert jaccard_join.PERCENT == 80


def test_packed_sequences_follow_the_mix(spark, tmp_path):
    rows = [(i, words(150, i), "en", "src0" if i % 2 else "other", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    packed = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    assert {r["doc_id"] for r in packed} == set(range(600))
    early = sorted({r["sequence_id"] for r in packed})[: len({r["sequence_id"] for r in packed}) // 3]
    for count in (len(early) // 2, len(early)):
        tokens = {0: 0, 1: 0}
        for r in packed:
            if r["sequence_id"] <= early[count - 1]:
                tokens[r["doc_id"] % 2] += r["length"]
        assert abs(tokens[1] / (tokens[0] + tokens[1]) - 12 / 15) < 0.08, tokens


def test_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, mix_slot int"
    odd = [(None, "one two", None, None, None), (None, None, "en", "src0", 0), (5, "", "en", "src0", 0), (5, "a line of some length\nb", "en", None, 3), (5, "a line of some length\nb", "en", None, 3), (6, "a line of some length\n" + words(20_000, 6), "en", "src1", None)]
    for name, rows in (("odd", odd), ("none", [])):
        at = tmp_path / name
        spark.createDataFrame([(*r, "x", 1) for r in rows], schema).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        docs = spark.read.parquet(str(at / "documents.parquet"))
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(at)).write.parquet(str(at / f"stage{n}"))
            docs = spark.read.parquet(str(at / f"stage{n}"))
            if n < 4:
                assert docs.columns == corpus_pipeline.COLUMNS and docs.count() == len(rows)
        pieces = docs.collect()
        assert sum(r["piece"] == 0 for r in pieces) == len(rows)
