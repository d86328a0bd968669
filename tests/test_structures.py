from pyspark.sql import functions as F

from strandflow.sources import structures as S

PDB = """HEADER    X
ATOM      1  N   MET A   1      11.104   6.134  -6.504  1.00  88.5           N
ATOM      2  CA  MET A   1      11.639   6.071  -5.147  1.00  88.50           C
HETATM    3  O5' LIG B   2       1.000   2.000   3.000  0.50  10.00           O
END
"""


def atoms(text):
    return [line[:66].split() for line in text.splitlines() if line.startswith(("ATOM", "HETATM"))]


def test_round_trip():
    cif = S.pdb_to_cif(PDB)
    assert S.structure_format(cif) == "cif" and S.structure_format(PDB) == "pdb"
    again = S.cif_to_pdb(cif)
    assert [a[:9] for a in atoms(again)] == [a[:9] for a in atoms(PDB)]
    assert S.cif_to_pdb(S.pdb_to_cif(again)) == again
    assert S.pdb_to_cif(None) is None and S.cif_to_pdb(None) is None and S.cif_to_pdb("data_x\n") == "END\n"


def test_models():
    two = "MODEL 1\n" + PDB.split("\n")[1] + "\nENDMDL\nMODEL 2\n" + PDB.split("\n")[2] + "\nENDMDL\n"
    back = S.cif_to_pdb(S.pdb_to_cif(two))
    assert back.count("MODEL ") == 2 and back.count("ENDMDL") == 2


def test_columns(spark):
    df = spark.createDataFrame([(PDB,), (None,), ("",)], "t string")
    r = df.select(S.to_pdb(S.to_cif(F.col("t"))).alias("p"), S.decompress(S.compress(F.col("t"))).alias("z")).collect()
    assert len(atoms(r[0]["p"])) == 3 and [x["z"] for x in r] == [PDB, None, ""] and r[1]["p"] is None
