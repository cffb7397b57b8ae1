import json

import pytest

from quizlens.sources import benchmarks as b
from quizlens.sources.synthetic import generate, planted, vocabulary


def write(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def item(k, **change):
    return {"id": f"i{k}", "question": f"Wie groß ist {k}?", "choices": ["a", "b"], "answer_index": k % 2} | change


def test_canonical_round_trip(spark, tmp_path):
    source = write(tmp_path / "c.jsonl", item(0, subject="x y"), "", "   ", item(1))
    rows = b.read_canonical(spark, source)
    assert [(r.pos, r.item_id, r.subject) for r in rows.orderBy("pos").collect()] == [(0, "i0", "x y"), (1, "i1", "")]
    b.write_canonical(rows, str(tmp_path / "out"))
    text = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines()[1] == '{"answer_index":1,"choices":["a","b"],"id":"i1","question":"Wie groß ist 1?"}'
    again = b.read_canonical(spark, str(tmp_path / "out"))
    assert again.drop("pos").exceptAll(rows.drop("pos")).isEmpty()


@pytest.mark.parametrize(
    ("bad", "fault"),
    [
        ("{", "not a JSON object"),
        ("[1]", "not a JSON object"),
        ({"id": "x", "question": "q", "choices": ["a", "b"]}, "answer_index is missing"),
        (item(5, answer_index=True), "answer_index is not of type"),
        (item(5, answer_index="1"), "answer_index is not of type"),
        (item(5, choices="ab"), "choices is not of type"),
        (item(5, choices=["a", 1]), "choices is not of type"),
        (item(5, id=7), "id is not of type"),
        (item(5, subject=7), "subject is not of type"),
        (item(5, id=""), "missing or empty"),
        (item(5, choices=["a"]), "fewer than two"),
        (item(5, answer_index=2), "outside the options"),
        (item(5, answer_index=-1), "outside the options"),
    ],
)
def test_canonical_refuses_with_file_and_line(spark, tmp_path, bad, fault):
    source = write(tmp_path / "c.jsonl", item(0), "", bad)
    with pytest.raises(b.CorpusError, match=rf"c\.jsonl:3: .*{fault}"):
        b.read_canonical(spark, source)


def test_repeated_ids_and_empty_files_are_refused(spark, tmp_path):
    with pytest.raises(b.CorpusError, match="more than once"):
        b.read_canonical(spark, write(tmp_path / "c.jsonl", item(0), item(0)))
    with pytest.raises(b.CorpusError, match="no items"):
        b.read_canonical(spark, write(tmp_path / "e.jsonl", ""))


def test_line_numbers_over_many_splits(spark, tmp_path):
    for f in range(3):
        write(tmp_path / f"part{f}.txt", *(f"{f}-{k}" for k in range(1, 4001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = b.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 12000
    assert all(r.value == f"{r.file.rsplit('part', 1)[1][0]}-{r.line_no}" for r in rows)


def test_mmlu_csv(spark, tmp_path):
    write(tmp_path / "high_school_x.csv", 'What, "they"' + ",1,2,3,4,B", '"a ""quoted"" one\nin two lines",x,y,D', ",,,", "q,x,y,z,3")
    with pytest.raises(b.CorpusError, match=r"high_school_x\.csv:2: the answer names no option"):
        b.read_mmlu_csv(spark, str(tmp_path / "high_school_x.csv"))
    write(tmp_path / "high_school_x.csv", "Which,1,2,3,4,B", '"a ""quoted"" one\nin two lines",x,y,A', ",,,", "q,x,y,z,3")
    rows = b.read_mmlu_csv(spark, str(tmp_path / "high_school_x.csv")).orderBy("pos").collect()
    assert [(r.item_id, r.subject, r.answer_index, len(r.choices)) for r in rows] == [
        ("high_school_x-00001", "high school x", 1, 4),
        ("high_school_x-00002", "high school x", 0, 2),
        ("high_school_x-00004", "high school x", 2, 3),
    ]
    assert rows[1].question == 'a "quoted" one\nin two lines'
    write(tmp_path / "anatomy.csv", "first,1,2,A")
    both = b.read_mmlu_csv(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.item_id for r in both][0] == "anatomy-00001" and len(both) == 4
    assert b.read_mmlu_csv(spark, str(tmp_path / "anatomy.csv"), subject="own").first().subject == "own"
    write(tmp_path / "short.csv", "q,a,A")
    with pytest.raises(b.CorpusError, match="fewer than 4 columns"):
        b.read_mmlu_csv(spark, str(tmp_path / "short.csv"))
    (tmp_path / "none").mkdir()
    with pytest.raises(b.CorpusError, match="no CSV file"):
        b.read_mmlu_csv(spark, str(tmp_path / "none"))


def arc(k, labels, key, **change):
    return {"id": f"a{k}", "question": {"stem": "s", "choices": [{"text": f"t{x}", "label": x} for x in labels]}, "answerKey": key} | change


def test_arc_jsonl(spark, tmp_path):
    rows = b.read_arc_jsonl(spark, write(tmp_path / "a.jsonl", arc(0, "ABCD", "C"), arc(1, "1234", "4"), arc(2, ["x", "y"], "y"), arc(3, ["x", "y"], "B"))).orderBy("pos").collect()
    assert [r.answer_index for r in rows] == [2, 3, 1, 1]
    for bad, fault in ((arc(0, "AB", "Q"), "names no option"), (arc(0, "AB", "AB"), "names no option"), ({"id": "a", "answerKey": "A"}, "question.stem is missing")):
        with pytest.raises(b.CorpusError, match=fault):
            b.read_arc_jsonl(spark, write(tmp_path / "b.jsonl", bad))


def test_hellaswag(spark, tmp_path):
    row = {"ind": 4, "ctx": "c", "endings": ["x", "y"], "label": "1", "activity_label": "Knots"}
    got = b.read_hellaswag(spark, write(tmp_path / "h.jsonl", row, row | {"ind": 5, "label": 0, "ctx_a": "only a"} | {"ctx": None})).orderBy("pos").collect()
    assert [(r.item_id, r.question, r.answer_index, r.subject) for r in got] == [("4", "c", 1, "Knots"), ("5", "only a", 0, "Knots")]
    for change, fault in (({"label": ""}, "label is empty"), ({"label": "x"}, "not a number"), ({"endings": []}, "endings are missing"), ({"label": 7}, "outside")):
        with pytest.raises(b.CorpusError, match=fault):
            b.read_hellaswag(spark, write(tmp_path / "h.jsonl", row | change))


def test_truthfulqa_keeps_the_order(spark, tmp_path):
    row = {"question": "q", "mc1_targets": {"zeta": 0, "alpha": 1, "mid": 0}, "category": "Law"}
    got = b.read_truthfulqa(spark, write(tmp_path / "t.jsonl", row)).first()
    assert (got.choices, got.answer_index, got.subject, got.item_id) == (["zeta", "alpha", "mid"], 1, "Law", "t-00001")
    for bad, fault in (({"question": "q"}, "mc1_targets is missing"), (row | {"mc1_targets": {"a": 1, "b": 1}}, "exactly one"), (row | {"mc1_targets": {"a": 0, "b": 0}}, "exactly one")):
        with pytest.raises(b.CorpusError, match=fault):
            b.read_truthfulqa(spark, write(tmp_path / "t.jsonl", bad))


def test_parquet_layouts(spark, tmp_path):
    spark.createDataFrame([("x1", "q", (["u", "v"], ["A", "B"]), "B")], "id string, question string, choices struct<text: array<string>, label: array<string>>, answerKey string").coalesce(1).write.parquet(str(tmp_path / "arc"))
    assert b.read_arc_parquet(spark, str(tmp_path / "arc")).first().answer_index == 1
    spark.createDataFrame([("q1", ["u", "v"], 1, "law"), ("q2", ["u", "v"], 0, "law")], "question string, choices array<string>, answer int, subject string").coalesce(1).write.parquet(str(tmp_path / "mmlu"))
    assert [r.item_id for r in b.read_mmlu_parquet(spark, str(tmp_path / "mmlu")).orderBy("pos").collect()] == ["law-00001", "law-00002"]


def test_from_items_and_union(spark):
    one = b.from_items(spark, [("a", "q", ("x", "y"), 0), ("b", "q", ("x", "y"), 1, "s")])
    two = b.from_items(spark, [("c", "q", ("x", "y"), 0)])
    assert [(r.pos, r.item_id) for r in b.union_corpora([one, two]).orderBy("pos").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    for bad in (("", "q", ("x", "y"), 0), ("a", "q", ("x",), 0), ("a", "q", ("x", "y"), 2)):
        with pytest.raises(ValueError):
            b.from_items(spark, [bad])
    assert set(b.LOADERS) == {"canonical", "mmlu", "mmlu-dir", "mmlu-parquet", "arc", "arc-parquet", "hellaswag", "truthfulqa"}


def test_synthetic_does_not_depend_on_the_partitioning(spark):
    rates = {"repeat": 0.1, "marker": 0.5, "longest": 0.3, "position": 0.4}
    a = generate(spark, 50, 5, **rates).collect()
    assert sorted(a) == sorted(generate(spark, 50, 5, **rates).repartition(7).collect())
    assert len(a) == 55 and {len(w) for w in vocabulary()} == {7} and len(set(vocabulary())) == len(vocabulary())
    assert planted(0.4, 4) == pytest.approx(0.55)
    for bad in ({"n": 0}, {"n": 9, "choices": 1}, {"n": 9, "position": 2.0}, {"n": 9, "favoured": 4}):
        with pytest.raises(ValueError):
            generate(spark, **bad)
