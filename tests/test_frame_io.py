import gzip
import json
import zipfile

import pytest

from strandflow.frame import FrameMeta, SequenceFrame, infer_molecule, normalize
from strandflow.operators.checks import check_expression, check_name, check_select
from strandflow.sources import readers, writers

ROWS = [{"sequence": "MKLLIV", "id": "seq1"}, {"sequence": "ACDEFGHIKLMNPQRSTVWY", "id": "seq2"}, {"sequence": "ATCGATCG", "id": "seq3"}]


def test_lazy_verbs(spark):
    f = SequenceFrame.from_rows(spark, ROWS)
    assert f.columns[:4] == ["id", "sequence", "sequence_hash", "length"] and f.shape() == (3, 4)
    assert [r["id"] for r in f.query.filter("length > 6").query.sort("length").query.limit(1).collect()] == ["seq3"]
    assert f.query.select("id, length").columns == ["id", "length"]
    assert f.query.group_by(agg={"n": "count(*)"}).collect() == [{"n": 3}]
    assert f.add_column("twice", "length * 2").query.select("twice").query.sort("twice", ascending=False).head(1).first()[0] == 40
    assert f.bio.detect_type().query.select("molecule_type").count() == 3
    assert f.head(0).count() == 0
    for bad in (lambda: f.query.limit(-1), lambda: f.query.group_by("id", agg={}), lambda: f.query.select("id; drop"), lambda: f.query.filter("1=1; drop table x"), lambda: f.query.join(f, how="cross")):
        with pytest.raises(ValueError):
            bad()


def test_join_keeps_left_order(spark):
    a = SequenceFrame.from_rows(spark, [{"sequence": "MKLLIV", "id": "a", "score": 0.5}])
    b = SequenceFrame.from_rows(spark, [{"sequence": "MKLLIV", "id": "b", "annotation": "x"}])
    j = a.query.join(b)
    assert j.columns == ["id", "sequence", "sequence_hash", "length", "score", "annotation"]
    assert j.collect()[0]["annotation"] == "x"
    m = a.merge_columns(b.df.select("sequence_hash", "id"), on="sequence_hash")
    assert m.columns[-1] == "id_enriched" and m.collect()[0]["id_enriched"] == "b"


def test_normalize(spark):
    df = spark.createDataFrame([(None, "AC", {"k": "v"}), ("x", "GG", None)], "id string, seq string, metadata map<string,string>")
    got = normalize(df, "seq").collect()
    assert {r["id"] for r in got} == {"seq_1", "x"} and json.loads(next(r["metadata"] for r in got if r["sequence"] == "AC")) == {"k": "v"}
    for bad in (df.limit(0), df.drop("seq"), spark.createDataFrame([(None,)], "sequence string")):
        with pytest.raises(ValueError):
            normalize(bad, "sequence" if "seq" not in bad.columns else "seq")


def test_molecules(spark):
    t = lambda *s: infer_molecule(spark.createDataFrame([(x,) for x in s], "sequence string"))
    assert t("ATCG", "GG") == "dna" and t("ATCG", "MKL") == "unknown" and t("MKL", "???") == "protein"
    with pytest.raises(ValueError):
        SequenceFrame.from_rows(spark, [{"sequence": "MKLLIV"}]).bio.translate()


def test_write_and_read(spark, tmp_path):
    f = SequenceFrame.from_rows(spark, ROWS, molecule_type="protein")
    g = f.write(str(tmp_path / "f"))
    assert g.meta == FrameMeta(molecule_type="protein") and g.count() == 3
    f.df.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError):
        SequenceFrame.read(spark, str(tmp_path / "plain"))


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_bytes(b">seq1|protein|test\r\nMKL\r\nLIV\r\n\r\n>seq2 description here\nACDE\n>seq3\nATCG\n>\nGG\n>empty\n>a|b > c\nTT")
    got = {r["id"]: r for r in readers.read_fasta(spark, str(p)).collect()}
    assert {k: r["sequence"] for k, r in got.items()} == {"seq1": "MKLLIV", "seq2": "ACDE", "seq3": "ATCG", "sequence": "GG", "a": "TT"}
    assert got["seq1"]["metadata"] == {"metadata_1": "protein", "metadata_2": "test"} and got["seq2"]["description"] == "description here"
    bare = tmp_path / "bare.fasta"
    bare.write_text("MKL\nIV\n>b\nAC\n")
    assert {r["id"]: r["sequence"] for r in readers.read_fasta(spark, str(bare)).collect()} == {"sequence_1": "MKLIV", "b": "AC"}
    (tmp_path / "none.fasta").write_text("\n\n")
    with pytest.raises(ValueError):
        readers.read_fasta(spark, str(tmp_path / "none.fasta"))
    df = spark.createDataFrame([("a", "M" * 90, "d", "x")], "id string, sequence string, description string, other string")
    assert writers.fasta_records(df, metadata=["other", "description"], wrap=80).first()[0] == ">a|d|x\n" + "M" * 80 + "\n" + "M" * 10
    with pytest.raises(ValueError):
        writers.fasta_records(df, "nope")


def test_csv_json_pdb_txt(spark, tmp_path):
    c = tmp_path / "x.csv"
    c.write_text('sequence,id,score\nMKL,a,0.5\nACD,,"1,2"\n')
    rows = readers.read_csv_strings(spark, str(c)).collect()
    assert [tuple(r) for r in rows] == [("MKL", "a", "0.5"), ("ACD", "", "1,2")]
    with pytest.raises(ValueError):
        readers.read_csv_strings(spark, str(c), "nope")
    for name, body in (("a.json", '[{"p": "A"}, {"q": "B"}]'), ("b.json", '{"items": [{"p": "A"}, {"q": "B"}]}'), ("c.jsonl", '{"p": "A"}\n{"q": "B"}\n')):
        (tmp_path / name).write_text(body)
        assert readers.read_json_rows(spark, str(tmp_path / name)).count() == 2, name
    (tmp_path / "one.json").write_text('{"p": "A"}')
    assert readers.read_json_rows(spark, str(tmp_path / "one.json")).count() == 1
    (tmp_path / "bad.json").write_text('{"items": [1, 2]}')
    with pytest.raises(ValueError):
        readers.read_json_rows(spark, str(tmp_path / "bad.json"))
    (tmp_path / "m.pdb").write_text("HEADER\nMODEL 1\nATOM 1\nENDMDL\nMODEL 2\nATOM 2\nENDMDL\nEND\n")
    assert [r[0] for r in readers.read_pdb(spark, str(tmp_path / "m.pdb")).collect()] == ["MODEL 1\nATOM 1\nENDMDL", "MODEL 2\nATOM 2\nENDMDL"]
    (tmp_path / "s.pdb").write_text("HEADER\nATOM 1\n")
    assert readers.read_pdb(spark, str(tmp_path / "s.pdb")).first()[0] == "HEADER\nATOM 1"
    (tmp_path / "t.txt").write_text("MKL\n\n ACD \n")
    assert readers.read_sequences(spark, str(tmp_path / "t.txt")).count() == 2
    with pytest.raises(ValueError):
        readers.read_sequences(spark, "x.doc")


def test_results(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("a.csv", "name,seq,tm\nx,MKL,5\n")
        z.writestr("b.jsonl", '{"a": 1}\n{"a": 2}\n')
    f = SequenceFrame.from_run_result(spark, str(tmp_path / "r.zip"))
    assert f.collect()[0]["id"] == "x" and f.collect()[0]["sequence"] == "MKL"
    assert readers.read_results(spark, str(tmp_path / "r.zip")).count() == 2
    assert readers.read_results(spark, [{"a": 1}, {"b": 2}]).count() == 2
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as g:
        g.write('{"a": 1}\n')
    assert readers.read_results(spark, str(tmp_path / "r.jsonl.gz")).count() == 1


def test_lab(spark):
    rec = [{"entity": {"entity_id": "e1", "type": "protein", "representation": "MKL"}, "tags": {"t": "x"}, "metrics": {"m": 1.5}, "parameters": {"p": "q"}}, {"entity": {}, "tags": {"construct_name": "c9"}}]
    f = SequenceFrame.from_lab(spark.createDataFrame([(json.dumps(rec),)], "records string"))
    got = {r["id"]: r for r in f.collect()}
    assert got["e1"]["sequence"] == "MKL" and got["e1"]["metric_m"] == 1.5 and got["e1"]["param_p"] == "q" and got["c9"]["sequence"] == "c9" and f.meta.molecule_type == "protein"
    assert f.io.to_order("svc")["sequences"][0]["id"] in ("e1", "c9")


def test_datasets(spark, tmp_path):
    f = SequenceFrame.from_rows(spark, ROWS)
    f.io.to_dataset(str(tmp_path), "one", tags=["a", "b"])
    with pytest.raises(FileExistsError):
        f.io.to_dataset(str(tmp_path), "one")
    f.io.to_dataset(str(tmp_path), "one", force=True, tags=["a", "b"])
    cat = readers.Catalog(spark, str(tmp_path))
    assert cat.listing(tag="a").count() == 1 and cat.listing(kind="other").count() == 0
    assert SequenceFrame.from_dataset(cat, "one").count() == 3
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "dataset.yaml").write_text('{"id": "one"}')
    with pytest.raises(ValueError):
        cat.entries()


def test_guards():
    check_name("abc_1")
    check_expression("a = 'drop; table'")
    check_select("with x as (select 1) select * from x")
    for f, bad in ((check_name, "a b"), (check_name, "1a"), (check_expression, "a; b"), (check_expression, "DROP x"), (check_expression, "a -- b"), (check_select, "delete from x")):
        with pytest.raises(ValueError):
            f(bad)


def test_lab_rows_refuse_more_keys_than_the_limit(spark):
    rec = [{"entity": {"entity_id": "e"}, "tags": {}, "metrics": {f"m{k}": 1.0 for k in range(21)}, "parameters": {}}]
    df = spark.createDataFrame([(json.dumps(rec),)], "records string")
    assert len([c for c in readers.lab_rows(df, max_keys=21).columns if c.startswith("metric_")]) == 21
    with pytest.raises(ValueError, match="more than 20 keys in metrics"):
        readers.lab_rows(df, max_keys=20)
    types = spark.createDataFrame([(f"t{k}",) for k in range(3000)] + [("dna_sequence",)], "entity_type string")
    assert readers.lab_molecule_type(types) == "dna"


def test_lab_rows_drop_no_keys_silently(spark):
    rec = [{"entity": {"entity_id": "e"}, "tags": {f"t{k}": "v" for k in range(5001)}, "metrics": {}, "parameters": {}}]
    with pytest.raises(ValueError, match="more than 5000 keys in tags"):
        readers.lab_rows(spark.createDataFrame([(json.dumps(rec),)], "records string"))
