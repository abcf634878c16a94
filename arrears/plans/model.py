"""The whole star: every fact and dimension for one set of sources.

Datasets are built once per ``Model`` and shared, so a KPI that reads
two facts, or a report over all of them, is one logical plan in which
Spark reuses identical sub-plans (and their shuffles).
"""

from __future__ import annotations

import copy
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame

from arrears.config import Params
from arrears.plans import dims, facts
from arrears.session import checkpoint_dir, shared_path
from arrears.sources.catalog import Sources

#: Datasets that are written at a time; small ones then fill what a large one leaves idle.
WRITERS = 4


class Model:
    def __init__(self, src: Sources, events: Params, orders: Params | None = None):
        self.src = src
        self.pe = events              # dialer, contacts, operators
        self.po = orders or events    # promises, payments, cases

    @cached_property
    def fact_dialer(self) -> DataFrame:
        return facts.fact_dialer(self.src, self.pe)

    @cached_property
    def fact_contacts(self) -> DataFrame:
        return facts.fact_contacts(self.src, self.pe)

    @cached_property
    def fact_ptp(self) -> DataFrame:
        return facts.fact_ptp(self.src, self.po)

    @cached_property
    def fact_ptp_enriched(self) -> DataFrame:
        return facts.fact_ptp_enriched(self.src, self.po)

    @cached_property
    def fact_payments(self) -> DataFrame:
        return facts.fact_payments(self.src, self.po)

    @cached_property
    def cc_operator_activity(self) -> DataFrame:
        return facts.cc_operator_activity(self.src, self.pe)

    @cached_property
    def fact_operator_presence(self) -> DataFrame:
        return facts.fact_operator_presence(self.src, self.pe)

    @cached_property
    def dim_operators(self) -> DataFrame:
        return facts.dim_operators(self.src, self.pe)

    @cached_property
    def dim_cases(self) -> DataFrame:
        return dims.dim_cases(self.src, self.po)

    @cached_property
    def dim_client(self) -> DataFrame:
        return dims.dim_client(self.src)

    @cached_property
    def dim_company(self) -> DataFrame:
        return dims.dim_company(self.src)

    @cached_property
    def dim_commission_rules(self) -> DataFrame:
        return dims.dim_commission_rules(self.src)

    # ------------------------------------------------------------ lineage
    DATASETS = ("fact_dialer", "fact_contacts", "fact_ptp", "fact_ptp_enriched", "fact_payments",
             "cc_operator_activity", "fact_operator_presence", "dim_operators", "dim_cases",
             "dim_client", "dim_company", "dim_commission_rules")

    def checkpoint(self, *names: str) -> "Model":
        """Materialise datasets with a reliable checkpoint (files under the
        session's ``spark.checkpoint.dir``, a shared folder on a cluster) and
        use those from now on: later reports start from the files, so a lost
        executor never recomputes the raw history."""
        checkpoint_dir(self.src.spark)
        for n in names or self.DATASETS:
            self.__dict__[n] = getattr(self, n).checkpoint(eager=True)
        return self


    def stored(self, columns: Mapping[str, Sequence[str]], **more: DataFrame) -> "Model":
        """The model with some columns of the named datasets (and further frames, as attributes)
        written once to the shared folder, side by side, and read from there: a report that
        looks at a dataset in several ways computes it once. What is stored already stays."""
        spark, base = self.src.spark, shared_path(self.src.spark, "model")
        out = copy.copy(self)
        out.__dict__["_stored"] = set(self.__dict__.get("_stored", ()))
        todo = {**{n: getattr(self, n).select(*c) for n, c in columns.items() if n not in out._stored}, **more}

        def write(item: tuple[str, DataFrame]) -> tuple[str, DataFrame]:
            name, df = item
            df.write.parquet(f"{base}/{name}")
            return name, spark.read.schema(df.schema).parquet(f"{base}/{name}")

        with ThreadPoolExecutor(WRITERS) as pool:
            for name, df in pool.map(write, todo.items()):
                out.__dict__[name] = df
                out._stored.add(name)
        return out


class StoredModel(Model):
    """A model that reads the named datasets from tables written by
    ``sources.sink.write_gold`` (one folder each) and computes only the
    others from ``src``. A named table that is missing is an error."""

    def __init__(self, src: Sources, gold_base: str, names: Sequence[str], events: Params,
                 orders: Params | None = None, fmt: str = "parquet"):
        super().__init__(src, events, orders)
        unknown = set(names) - set(self.DATASETS)
        if unknown:
            raise ValueError(f"no such datasets: {sorted(unknown)}")
        computed = Model(src, events, orders)
        for n in names:
            stored = src.spark.read.format(fmt).load(f"{gold_base.rstrip('/')}/{n}")
            # A partition column comes back last: restore the declared order.
            self.__dict__[n] = stored.select(*getattr(computed, n).columns)
        self.__dict__["_stored"] = set(names)
