"""The privacy model's metadata: which columns play which part, and how strict it is."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import quoted
from .plans.storage import materialise

MODELS = ("k", "l", "t")
CATEGORICAL_TYPES = (
    T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


@dataclass(frozen=True)
class PrivacySpec:
    """Immutable run context; operators return a new one rather than change it.

    ``order_by`` names a unique column: it stands for the row order on which first-seen
    rules (category split, joined lists, integer codes) depend.
    """

    sensitive: str
    features: tuple[str, ...]
    categorical: frozenset[str]
    columns: tuple[str, ...]
    order_by: str
    k: int = 3
    l: int | None = 2
    p: float | None = 0.2

    @classmethod
    def for_table(
        cls,
        df: DataFrame,
        sensitive: str,
        order_by: str,
        features: list[str] | None = None,
        categorical: set[str] | None = None,
        k: int = 3,
        l: int | None = 2,
        p: float | None = 0.2,
    ) -> PrivacySpec:
        """Fill in what is not given from the table: text, boolean and date columns are
        categorical, and every column but the sensitive one and the order is a feature."""
        columns = tuple(df.columns)
        if categorical is None:
            categorical = {
                f.name
                for f in df.schema.fields
                if isinstance(f.dataType, CATEGORICAL_TYPES)
            }
        if features is None:
            features = [c for c in columns if c not in (sensitive, order_by)]
        for name in (sensitive, order_by, *features):
            if name not in columns:
                raise ValueError(f"no column named {name!r}")
        return cls(
            sensitive, tuple(features), frozenset(categorical), columns, order_by, k, l, p
        )

    def is_categorical(self, column: str) -> bool:
        return column in self.categorical

    def with_features(self, features) -> PrivacySpec:
        return replace(self, features=tuple(features))

    def with_categorical(self, *columns: str) -> PrivacySpec:
        return replace(self, categorical=self.categorical | set(columns))

    def check_model(self, model: str) -> None:
        if model not in MODELS:
            raise ValueError(f"unknown privacy model {model!r}; expected one of {MODELS}")
        if model == "l" and self.l is None:
            raise ValueError("model 'l' needs l")
        if model == "t":
            if self.p is None:
                raise ValueError("model 't' needs p")
            if not self.is_categorical(self.sensitive):
                raise ValueError("t-closeness needs a categorical sensitive column")

    def __str__(self) -> str:
        """One line: what protects which column, and by which features."""
        listed = [f"{c}*" if self.is_categorical(c) else c for c in self.features]
        bounds = f"k={self.k}, l={self.l}, p={self.p}"
        return f"{self.sensitive} by {', '.join(listed)} in order of {self.order_by} ({bounds}; * categorical)"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in floating-point columns, so one rule covers both."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.nanvl(quoted(c), F.lit(None)) for c in floats}) if floats else df


def with_row_order(df: DataFrame, name: str = "row_order") -> DataFrame:
    """Give a table without a unique key a stable one, written once."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()))
