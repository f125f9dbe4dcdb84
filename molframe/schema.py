"""Fixed name sets and layouts of the molecular tables. Every table is keyed by structure_id (`sid`)."""

from __future__ import annotations

from pyspark.sql import types as T

# Residue names.
PROTEIN = [
    "ALA", "ARG", "ASN", "ASP", "ASH", "CYS", "CYM", "CYX", "GLN", "GLU", "GLH", "GLY", "HIS", "HID", "HIE", "HIP", "HYP", "ILE", "LEU", "LYN", "LYS", "MET", "PHE", "PRO", "SER", "THR",
    "TRP", "TYR", "VAL", "NLN", "OLS", "OLT", "OLP",
]
WATER = ["HOH", "WAT", "TIP", "TP3"]
FREE_IONS = ["NA", "NA+", "CL", "CL-", "K", "K+", "MG", "MG2+", "CA", "CA2+"]
# Template name endings of a carbohydrate's three-letter code.
SUGAR_ENDINGS = {
    "NAG": ["YB"], "NDG": ["YA"], "MAN": ["MA"], "BMA": ["MB"], "GLC": ["GA"], "BGC": ["GB"], "GAL": ["LA", "LB"], "GLA": ["LA"], "FUC": ["fA"], "FUL": ["fB"],
    "XYS": ["XB"], "XYP": ["XB"], "SIA": ["SA", "SB"], "SLB": ["SA", "SB"],
}
# Residue and attachment atom to the glycosylated residue's name.
GLYCOSYLATED = [("ASN", "ND2", "NLN"), ("SER", "OG", "OLS"), ("THR", "OG1", "OLT"), ("HYP", "OD1", "OLP")]
# Atom names that may be bonded across residues, and the cut-off.
CROSS_BONDS = [("O1", "C1", 1.9), ("O2", "C1", 1.9), ("O3", "C1", 1.9), ("O4", "C1", 1.9), ("O6", "C1", 1.9), ("O8", "C2", 1.9), ("ND2", "C1", 1.9), ("OG", "C1", 1.9), ("OG1", "C1", 1.9), ("OD1", "C1", 1.9), ("SG", "SG", 2.3)]
# Masses by element where no parameter names the type.
MASSES = {1: 1.008, 6: 12.01, 7: 14.01, 8: 16.00, 11: 22.98977, 15: 30.97, 16: 32.06, 17: 35.45}
# Fixed values of the implicit-solvent model and of unit conversion.
GB_RADII = {1: 1.2, 6: 1.7, 7: 1.55, 8: 1.5, 15: 1.85, 16: 1.8}
GB_RADIUS_ELSE, GB_RADIUS_AMIDE_H = 1.5, 1.3
GB_SCREEN = {1: 0.85, 6: 0.72, 7: 0.79, 8: 0.85, 15: 0.86, 16: 0.96}
GB_SCREEN_ELSE = 0.8
COULOMB = 332.063713299
CHARGE_SCALE = 18.2223
SCEE, SCNB = 1.2, 2.0

# Fixed columns of PDB records.
ATOM_FIELDS = [("serial", 6, 11, "long"), ("name", 12, 16, "string"), ("residue_name", 17, 20, "string"), ("chain", 21, 22, "string"), ("number", 22, 26, "int"), ("x", 30, 38, "double"), ("y", 38, 46, "double"), ("z", 46, 54, "double"), ("occupancy", 54, 60, "double"), ("element", 76, 78, "string")]
LINK_FIELDS = [("atom1", 12, 16, "string"), ("chain1", 21, 22, "string"), ("number1", 22, 26, "int"), ("atom2", 42, 46, "string"), ("chain2", 51, 52, "string"), ("number2", 52, 56, "int")]
SSBOND_FIELDS = [("chain1", 15, 16, "string"), ("number1", 17, 21, "int"), ("chain2", 29, 30, "string"), ("number2", 31, 35, "int")]

TEMPLATE_ATOMS = T.StructType([T.StructField("family", T.StringType()), T.StructField("template", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("atom_type", T.StringType()), T.StructField("element", T.IntegerType()), T.StructField("charge", T.DoubleType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType())])
TEMPLATE_BONDS = T.StructType([T.StructField("family", T.StringType()), T.StructField("template", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
VIOLATION = "sid string, code string, subject string, message string"
