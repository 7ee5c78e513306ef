"""The engine's functions under names that SQL texts can use."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from hushframe.operators.restore import Restorer
from hushframe.operators.scan import Scanner, masked
from hushframe.sources.catalog import Catalog, load_rules

from .validators import _Named, passes


def register(spark: SparkSession, catalog: Catalog | None = None) -> list[str]:
    """Registers, for this session's SQL, and returns the names of:

    hush_mask(text): the text with the catalogue's findings replaced, as a request of its own; hush_findings(text): their
    rule ids, in order; hush_restore(text, replacements): exactly restored, replacements being an array of structs with
    placeholder and original; hush_valid(value, validator): whether a value passes, null for a null.
    """
    scanner = Scanner((catalog or load_rules()).rules)

    @pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        found = scanner.findings(pa.array(texts, pa.string()))
        return pd.Series([None if t is None else masked(t, spans)[0] for t, spans in zip(texts, found, strict=True)], dtype=object)

    @pandas_udf("array<string>")
    def findings(texts: pd.Series) -> pd.Series:
        return pd.Series([[s.rule.rule_id for s in spans] for spans in scanner.findings(pa.array(texts, pa.string()))], dtype=object)

    @pandas_udf("string")
    def restore(texts: pd.Series, known: pd.Series) -> pd.Series:
        pairs = ([(k["placeholder"], k["original"]) for k in (ks if ks is not None else [])] for ks in known)
        return pd.Series([t if t is None or not p else Restorer(p).whole(t) for t, p in zip(texts, pairs, strict=True)], dtype=object)

    @pandas_udf("boolean")
    def valid(values: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else passes(v, _Named((n,), 0.0, ())) for v, n in zip(values, names, strict=True)], dtype="boolean")

    made = {"hush_mask": mask, "hush_findings": findings, "hush_restore": restore, "hush_valid": valid}
    for name, function in made.items():
        spark.udf.register(name, function)
    return list(made)
