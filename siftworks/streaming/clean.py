"""Row-level cleaning on streams. The expressions of the text functions and the fitted column stages are stateless, so a
stream takes them as it is; nothing here keeps state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.english import with_drop_reason
from ..functions.text import TextSpec, clean_text


def clean_stream(stream: DataFrame, text_cols: Sequence[str] = (), spec: TextSpec = TextSpec(), fitted: Model | None = None,
                 english_only: bool = False) -> DataFrame:
    """The same cleaning a batch gets, with parameters fitted beforehand."""
    out = fitted.transform(stream) if fitted is not None else stream
    if english_only and text_cols:
        out = with_drop_reason(out, text_cols).filter("drop_reason IS NULL").drop("drop_reason")
    return out.withColumns({f"{c}_processed": clean_text(F.col(c), spec) for c in text_cols}) if text_cols else out


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; the checkpoint folder makes a restart continue after the last batch."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
