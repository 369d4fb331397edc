"""Text, answer and vector services as pluggable functions over Arrow batches; tests and offline runs use the stubs."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Service = Callable[[list[str | None]], list]


def served(df: DataFrame, column: str, service: Callable[[], Service], name: str, kind: str, batch_rows: int = 256) -> DataFrame:
    """df with the service's answer to each text as a column of SQL type `kind`.

    `service` makes a client once for each task, so that connections are neither shipped nor opened by row; it is asked
    in lists of at most batch_rows and has to answer in order. A null text is passed on as null. A failed task is asked
    again from its start, so a service must bear repeated questions.
    """
    out = df.withColumn(name, F.lit(None).cast(kind))
    target = out.schema[name].dataType

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        answer = service()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                values = answer(part.column(column).to_pylist())
                if len(values) != part.num_rows:
                    raise ValueError(f"the service gave {len(values)} answers to {part.num_rows} questions")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, to_arrow_type(target))], names=[*part.schema.names, name])

    return df.mapInArrow(ask, out.schema)


def resilient(primary: Callable[[], Service], fallback: Callable[[], Service] | None = None, tries: int = 3, pause: Callable[[int], None] | None = None) -> Callable[[], Service]:
    """A service that is asked up to `tries` times, after pause(attempt) if given, and then the fallback, once.

    An error of the last resort goes on to the task. Both clients are made at most once for each task, the fallback only
    when it is needed.
    """
    def make() -> Service:
        clients: dict[str, Service] = {}

        def answer(texts: list[str | None]) -> list:
            for attempt in range(tries):
                try:
                    return clients.setdefault("primary", clients.get("primary") or primary())(texts)
                except Exception:  # noqa: BLE001  whatever the client raises
                    if attempt + 1 < tries:
                        if pause is not None:
                            pause(attempt)
                    elif fallback is None:
                        raise
            return clients.setdefault("fallback", clients.get("fallback") or fallback())(texts)

        return answer

    return make


def stub_vectors(dim: int) -> Callable[[], Service]:
    """Unit vectors that depend on the text alone; null for null."""

    def make() -> Service:
        def answer(texts: list[str | None]) -> list:
            out = []
            for text in texts:
                if text is None:
                    out.append(None)
                    continue
                vector = np.random.default_rng(xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))).standard_normal(dim)
                out.append((vector / np.linalg.norm(vector)).tolist())
            return out

        return answer

    return make


def stub_samples(answers: list[str], samples: int) -> Callable[[], Service]:
    """Several answers to each text, drawn by its hash: the same text is answered alike anywhere."""

    def make() -> Service:
        def answer(texts: list[str | None]) -> list:
            return [None if t is None else [answers[xxhash.xxh3_64_intdigest(f"{k}|{t}".encode("utf-8", "replace")) % len(answers)] for k in range(samples)] for t in texts]

        return answer

    return make
