"""Equations: keys, texts, notation, domains, first- and last-wins merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equarry.functions.text import catalog_key, filled, global_key, norm, replace_in_order

#: Literal replacements of the notation, in order.
NOTATION = [
    ("c_{w}", "c_{p}"), ("c_w", "c_p"), ("c_{pj}", "c_{p}"), ("C_{pj}", "c_{p}"), ("Cpj", "c_p"),
    ("Cp", "c_p"), ("C_p", "c_p"), ("k_{o}", "k_{0}"), ("k_o", "k_0"), ("ko", "k_0"),
]

#: Keywords, found anywhere and in any case, and the domain they merge into; the first rule that fires holds.
DOMAIN_RULES = [
    (["CSTR", "Stirred Tank", "Reactor", "Tubular Reactor", "Plug Flow", "Fed-Batch", "Isothermal CSTR", "Nonisothermal CSTR", "Two CSTRs"], "Reactor / CSTR"),
    (["Kinetics", "Transesterification", "Biodiesel"], "Reaction Kinetics"),
    (["Heat Transfer", "Heat Exchanger", "Heating", "Thermodynamics", "Thermochemistry", "Jacket", "Steam-Heated", "Cooling Coil"], "Heat Transfer / Thermodynamics"),
    (["Control", "PID", "Laplace", "Transfer Function", "State-Space", "Linear Systems", "Signal", "Frequency Response", "Block Diagram", "Stability"], "Control / Dynamics"),
    (["Material Balance", "Mole Balance", "Component continuity", "Overall Material Balance"], "Material Balance"),
    (["Energy Balance"], "Energy Balance"),
    (["Fluid", "Flow", "Tank Draining", "Surge Tank", "Weir", "CFD"], "Fluid / Flow"),
    (["Numerical", "Euler", "Runge-Kutta", "ODE"], "Numerical Methods"),
    (["Electrical", "Circuit"], "Electrical Circuits"),
    (["Mechanical", "Torque", "Electromechanical"], "Mechanical / Electromechanical"),
    (["Membrane", "Blending", "Staged", "Absorber"], "Separation / Mixing"),
    (["Linearization", "Taylor", "Degrees of Freedom", "Dimensionless"], "Modeling / Linearization"),
    (["Fuzzy", "Statistical"], "Other"),
    (["General", "Modeling Principles", "Mathematical Modeling", "Conservation Balance"], "General Modeling"),
]


def keyed_equations(equations: DataFrame) -> DataFrame:
    """equations with key; rows without one are dropped."""
    return equations.withColumn("key", global_key("source_id", "eq_id")).where("key is not null")


def first_wins(df: DataFrame, keys: list[str], order: str, carry: list[str]) -> DataFrame:
    """The row least in order of each key: keys, order and carry's columns. Partial aggregation keeps one row of a frequent key in
    each task, where a window would sort all of them in one. Null counts as a key; order is unique."""
    rest = [c for c in dict.fromkeys([order, *carry]) if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__v")).select(*keys, "__v.*")


def candidates(equations: DataFrame) -> DataFrame:
    """One row for each key, the first loaded: key, row_id, equation, variables, context_text, domain."""
    return first_wins(keyed_equations(equations), ["key"], "row_id", ["equation", "variables", "context_text", "domain"])


def last_wins(equations: DataFrame) -> DataFrame:
    """The last row_id of each key, and the number of rows that have it."""
    return keyed_equations(equations).groupBy("key").agg(F.max("row_id").alias("last_row_id"), F.count(F.lit(1)).alias("n_rows"))


def catalog(equations: DataFrame) -> DataFrame:
    """model_id as stored and the sorted variable symbols, for a generator's prompt; null maps have none."""
    symbols = F.array_join(F.array_sort(F.coalesce(F.map_keys("variables"), F.array().cast("array<string>"))), "|")
    return equations.select("row_id", catalog_key("source_id", "eq_id").alias("model_id"), F.coalesce("domain", F.lit("")).alias("domain"), symbols.alias("variable_symbols"))


def equation_text(context: str = "context_text", equation: str = "equation", domain: str = "domain") -> Column:
    """Context, equation and domain, trimmed, a line each; blank ones are left out."""
    return F.concat_ws("\n", filled(context), filled(equation), filled(domain))


def encoder_text() -> Column:
    return F.concat(F.lit("Equation: "), F.coalesce("equation", F.lit("")), F.lit("\nContext: "), F.coalesce("context_text", F.lit("")))


def case_text() -> Column:
    """The context with its input and output symbols; an empty list leaves its separator."""
    part = lambda c, word: F.when(F.size(c) > 0, F.concat(F.lit(word + " "), F.array_join(F.filter(F.transform(c, norm), lambda x: x != ""), " "))).otherwise("")
    return norm(F.concat(norm("context"), F.lit(" "), F.coalesce(part("input_variables", "INPUT"), F.lit("")), F.lit(" "), F.coalesce(part("output_variables", "OUTPUT"), F.lit(""))))


def normalized_equations(equations: DataFrame, rules=NOTATION) -> DataFrame:
    """Each equation after the ordered literal replacements; context texts stay as they are."""
    return equations.select("row_id", replace_in_order(F.col("equation"), rules).alias("equation"))


def normalized_variables(equations: DataFrame, rules=NOTATION) -> DataFrame:
    """(row_id, symbol, definition) after the replacements in both; where two symbols become one the later one's definition holds."""
    each = equations.select("row_id", F.posexplode("variables").alias("pos", "k", "v"))
    return each.groupBy("row_id", replace_in_order(F.col("k"), rules).alias("symbol")).agg(F.max(F.struct("pos", replace_in_order(F.col("v"), rules).alias("v"))).getField("v").alias("definition"))


def merged_domain(domain: str, rules=DOMAIN_RULES) -> Column:
    """The merged domain: Unknown for null, empty or unknown; Other where no rule fires."""
    low = F.lower(domain)
    out = F.when(F.coalesce(F.col(domain), F.lit("")).isin("", "unknown"), "Unknown")
    for words, name in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        out = out.when(hit, name)
    return out.otherwise("Other")


def new_rows(existing: DataFrame, new: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """The rows of new whose key existing lacks, the first of each key. Keys are as stored, and null counts as a key."""
    first = first_wins(new, keys, order, new.columns).select(*new.columns)
    known = existing.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return first.join(known, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")


def merge_new(existing: DataFrame, new: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """existing and the rows of new whose key it lacks, the first of each key; existing rows aren't deduplicated. Keys are as
    stored, and null counts as a key."""
    return existing.unionByName(new_rows(existing, new, keys, order))


def pending_files(equations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files seen but not in the ledger; names are trimmed, blank ones left out."""
    seen = equations.select(filled("source_id").alias("file_name")).where("file_name is not null").distinct()
    return seen.join(ledger.select(filled("file_name").alias("file_name")), "file_name", "left_anti")


def papers(df: DataFrame) -> DataFrame:
    """One row for each paper_id, the first by (query, pos): the address is the JSON object's url, or the bare string."""
    url = F.when(F.col("open_access").startswith("{"), F.get_json_object("open_access", "$.url")).otherwise(F.col("open_access"))
    rows = df.where(F.coalesce("paper_id", F.lit("")) != "").withColumn("url", url).withColumn("has_pdf", F.col("url").isNotNull())
    return first_wins(rows.withColumn("at", F.struct("query", "pos")), ["paper_id"], "at", ["url", "has_pdf"]).select("paper_id", F.col("at.query").alias("query"), F.col("at.pos").alias("pos"), "url", "has_pdf")
