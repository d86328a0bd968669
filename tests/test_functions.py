import hashlib
import math

import pytest
from pyspark.sql import functions as F

from strandflow.functions import bio, extract, vectors


def one(spark, column, **values):
    kind = lambda v: "string" if isinstance(v, (str, type(None))) else "array<double>" if isinstance(v, list) else "double"
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    return spark.range(1).select(*[lit(v).cast(kind(v)).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("s", "kind"), [("ATCG", "dna"), ("aucg", "rna"), ("MKLLIV", "protein"), ("MK1", "unknown"), ("", "dna"), ("AC:GT", "dna"), (None, None), ("MK*", "protein")])
def test_detect_type(spark, s, kind):
    assert one(spark, bio.detect_type("s"), s=s) == kind


@pytest.mark.parametrize(("a", "b", "d"), [("ABC", "ABC", 0), ("ABC", "ABD", 1), ("AB", "ABCD", 2), ("", "", 0), ("", "AB", 2)])
def test_hamming(spark, a, b, d):
    assert one(spark, bio.hamming("a", "b"), a=a, b=b) == d
    assert one(spark, bio.hamming_normalized("a", "b"), a=a, b=b) == (d / max(len(a), len(b)) if a or b else 0.0)


def test_identity(spark):
    assert one(spark, bio.identity("a", "b"), a="ABCD", b="ABXX") == 0.5
    assert one(spark, bio.identity("a", "b"), a="", b="A") == 0.0


def test_hashes(spark):
    assert one(spark, bio.sequence_hash("s"), s="mk") == hashlib.sha256(b"MK").hexdigest()[:16]
    assert one(spark, bio.store_hash("s"), s="mk") == hashlib.sha256(b"mk").hexdigest()[:32]
    assert one(spark, bio.row_hash(["b", "a"]), b="y", a="x") == hashlib.sha256(b"x\0y").hexdigest()[:32]
    assert one(spark, bio.row_hash(["b", "a"]), b="y", a=None) is None


@pytest.mark.parametrize(("s", "p"), [("ATGGCC", "MA"), ("ATGTAAG", "M*"), ("AUG", "M"), ("AT", ""), ("ANG", "X"), (None, None)])
def test_translate(spark, s, p):
    assert one(spark, bio.translate_codons("s"), s=s) == p


def test_reverse_complement(spark):
    assert one(spark, bio.reverse_complement("s"), s="atcgn") == "NCGAT"
    assert one(spark, bio.reverse_complement("s"), s="AUG") == "CUT"


def test_masks_and_mutations(spark):
    assert one(spark, bio.apply_mask("s", F.array(F.lit(0), F.lit(2), F.lit(9))), s="ABC") == "<mask>B<mask>"
    assert one(spark, bio.mutate_at("s", 1, "W"), s="ABC") == "AWC"
    assert one(spark, bio.mutation_count("s", F.lit("AXCD")), s="ABC") == 1


def test_length_bin(spark):
    assert [one(spark, bio.length_bin("s", [3, 5]), s="A" * n) for n in (2, 3, 4, 5)] == ["<3", "3-5", "3-5", ">5"]


def test_validators(spark):
    assert one(spark, bio.matches_alphabet("s"), s="") is False
    assert one(spark, bio.matches_alphabet("s", empty=True), s="") is True
    assert one(spark, bio.matches_alphabet("s"), s="MK\n") is False
    assert one(spark, bio.validate_sequence("s", "dna"), s="acgt") is True
    assert one(spark, bio.occurrences("s", "AA"), s="AAAAA") == 2
    assert one(spark, bio.usable_text("s"), s=" NaN ") is False
    assert one(spark, bio.usable_text("s"), s=None) is False


def test_vectors(spark):
    assert one(spark, vectors.argmax_symbol("v", "ABC"), v=[1.0, 3.0, 3.0]) == "B"
    p = one(spark, vectors.softmax("v", 2.0), v=[0.0, 2.0])
    assert math.isclose(p[1] / p[0], math.e)
    assert one(spark, vectors.top_probabilities(F.col("v"), top_k=1), v=[0.2, 0.5, 0.3]) == [0.0, 1.0, 0.0]
    assert [round(x, 3) for x in one(spark, vectors.top_probabilities(F.col("v"), top_p=0.6), v=[0.2, 0.5, 0.3])] == [0.0, 0.625, 0.375]
    assert one(spark, vectors.sample_symbol(F.col("v"), "ABC", F.lit(0.75)), v=[0.2, 0.5, 0.3]) == "C"
    assert one(spark, vectors.euclidean("v", F.array(F.lit(0.0), F.lit(0.0))), v=[3.0, 4.0]) == 5.0


def test_scalar_extraction(spark):
    assert one(spark, extract.scalar("j", "a.b"), j='{"a": {"b": 1.5}}') == 1.5
    assert one(spark, extract.scalar("j", "p"), j='{"p": [1, 2]}') is None
    assert one(spark, extract.scalar("j", "p", "mean"), j='{"p": [[0.5, 1.0], [1.5]]}') == 1.0
    assert one(spark, extract.scalar("j", "p", "max"), j='{"p": [3, 7]}') == 7.0
    assert one(spark, extract.scalar("j", "p", "max"), j='{"p": []}') is None
    assert one(spark, extract.scalar("j", "p"), j='{"p": "no"}') is None
    assert one(spark, extract.first_scalar("j"), j='{"odd": 4}') == "4"
    assert one(spark, extract.first_scalar("j"), j='{"x": 1, "score": 2}') == "2"


def test_embedding_extraction(spark):
    j = '{"embeddings": [{"layer": 3, "embedding": [1, 2]}, {"layer": 5, "embedding": [3, 4]}]}'
    assert one(spark, extract.embedding("j", "embeddings", layer=3), j=j) == [1.0, 2.0]
    assert one(spark, extract.embedding("j", "embeddings"), j=j) == [3.0, 4.0]
    assert one(spark, extract.embedding("j", "embeddings", layer=9), j=j) is None
    assert one(spark, extract.embedding("j"), j='{"embedding": [[1, 2], [3, 4]]}') is None
    assert one(spark, extract.embedding("j", reduction="mean"), j='{"embedding": [[1, 2], [3, 4]]}') == [2.0, 3.0]
    assert one(spark, extract.embedding("j", reduction="last"), j='{"embedding": [[1, 2], [3, 4]]}') == [3.0, 4.0]


def test_resolve():
    assert extract.resolve("p", "tm") == [extract.Extraction("p", "tm")]
    assert extract.resolve(["a", extract.Extraction("b", "b", "mean")], {"b": "m"})[1] == extract.Extraction("b", "m", "mean")
    for bad in (lambda: extract.resolve(["a", "b"], "x"), lambda: extract.resolve(["a"], {"z": "q"}), lambda: extract.resolve(["a", "a"]), lambda: extract.Extraction("a", "b", "median")):
        with pytest.raises(ValueError):
            bad()


def test_matrix_unpivot(spark):
    df = spark.createDataFrame([(1, [[1.0, None], [3.0, 4.0]], ["M", "K"], ["A", "C"])], "id int, m array<array<double>>, r array<string>, c array<string>")
    got = {(r[1], r[2]) for r in extract.unpivot_matrix(df, ["id"], "m", "r", "c", "d_").collect()}
    assert got == {("d_M1A", 1.0), ("d_K2A", 3.0), ("d_K2C", 4.0)}
    df = spark.createDataFrame([(1, '[{"mutation": "M1A", "value": -0.5}]')], "id int, j string")
    assert [tuple(r) for r in extract.unpivot_list(df, ["id"], "j").collect()] == [(1, "M1A", -0.5)]


def test_flatten_generated(spark):
    seqs = lambda j: [r["sequence"] for r in one(spark, extract.flatten_generated("j"), j=j)]
    assert seqs('{"sequence": "MK"}') == ["MK"]
    assert seqs('{"sequences": ["MK", "AC"]}') == ["MK", "AC"]
    assert seqs('[{"sequences": [{"heavy": "H", "light": "L"}]}]') == ["H:L"]
    assert seqs('[[{"sequence": "A", "log_prob": -1.2}]]') == ["A"]
    assert seqs('["AA", "CC"]') == ["AA", "CC"]


def test_structure_and_mapping(spark):
    s = one(spark, extract.structure("j", "pdb", plddt_key="mean_plddt"), j='{"pdb": "ATOM 2", "mean_plddt": 88}')
    assert tuple(s) == ("pdb", "ATOM 2", 88.0)
    assert one(spark, extract.structure("j", "cif", 1), j='{"cif": ["a", "b"]}')["structure_str"] == "b"
    assert extract.parse_mapping({"a": "results[*].pdb", "b": "${{ response.x }}", "c": {"path": "embedding"}}) == [("a", "pdb", "structure"), ("b", "x", "scalar"), ("c", "embedding", "embedding")]
