"""Schemas, label vocabularies and fixed tables."""

from __future__ import annotations

from pyspark.sql import types as T

SEGMENT = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)

READS = T.StructType(
    [
        T.StructField("read_id", T.LongType()),
        T.StructField("sequence", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("quality", T.ArrayType(T.FloatType())),
        T.StructField("is_invalid", T.BooleanType()),
        T.StructField("error_type", T.StringType()),
    ]
)

PWM = "pos int, base string, prob double"
CONSTRAINTS = "label string, min_len int, max_len int"
SAMPLES = "sheet_ordinal long, sample_name string, cbc string, i5 string, i7 string"

# The training vocabulary (position = number).
LABELS = (
    "p7",
    "i7",
    "RP2",
    "UMI",
    "ACC",
    "cDNA",
    "polyA",
    "CBC",
    "RP1",
    "i5",
    "p5",
    "ERROR_SUB",
    "ERROR_INS",
    "ERROR_BOUNDARY",
    "ERROR_ORDER",
    "ERROR_DUP",
    "ERROR_LOSS",
    "ERROR_UNKNOWN",
)
#: Labels that take the place of the base's own label (a read's structure goes through them), and those that end a run.
BENIGN = ("ERROR_SUB", "ERROR_INS")
ARCHITECTURAL = ("ERROR_BOUNDARY", "ERROR_ORDER", "ERROR_DUP", "ERROR_LOSS", "ERROR_UNKNOWN")

# The segments of a read, which of them have to be there, and which don't count for the order.
EXPECTED = ("p7", "i7", "RP2", "UMI", "ACC", "cDNA", "polyA", "CBC", "RP1", "i5", "p5")
REQUIRED = ("UMI", "ACC", "CBC")
OPTIONAL = ("polyA", "RP2", "RP1")

# IUPAC nucleotide codes.
IUPAC = {
    "A": "A",
    "C": "C",
    "G": "G",
    "T": "T",
    "R": "AG",
    "Y": "CT",
    "S": "CG",
    "W": "AT",
    "K": "GT",
    "M": "AC",
    "B": "CGT",
    "D": "AGT",
    "H": "ACT",
    "V": "ACG",
    "N": "ACGT",
}

# The three encodings of bases in use; what isn't listed gets ``other``. In training arrays U counts as A.
ENCODINGS = {
    "training": ({"A": 0, "C": 1, "G": 2, "T": 3, "N": 4, "U": 0}, 4),
    "demux": ({"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}, 0),
    "one_based": ({"A": 1, "C": 2, "G": 3, "T": 4, "N": 0}, 0),
}
