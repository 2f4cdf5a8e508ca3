"""Fluent form of the whole: Flows(df).filter("proto tcp").aggregate("srcip4/24,dstport").order("bytes").top(10).fmt()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.filterlang.compiler import apply_filter, derived
from freshet.filterlang.parser import parse
from freshet.operators import aggregate as agg
from freshet.operators import stat, summary
from freshet.operators.enrich import Lookups
from freshet.output import json as json_out
from freshet.output import tokens
from freshet.schema import DERIVED, normalise

# output token -> columns that lookups fill
SHOWN = {
    "sc": ["src_geo"], "dc": ["dst_geo"], "gsa": ["src_geo"], "gda": ["dst_geo"], "gsap": ["src_geo"], "gdap": ["dst_geo"], "stor": ["src_tor"], "dtor": ["dst_tor"], "sas": ["src_as"], "das": ["dst_as"],
    "sloc": ["src_location"], "dloc": ["dst_location"], "sasn": ["src_org"], "dasn": ["dst_org"],
}


class Flows:
    """A table of flow records and what has been asked of it so far; every step gives a new one.

    Countries, exit nodes and AS numbers that a filter, statistic, key or format asks for are looked up in `lookups`. A filter, statistic
    or key on a country or exit node that neither the table nor `lookups` knows is an error; formats show `..` there. AS numbers
    that are missing count as 0 without a table.
    """

    def __init__(self, df: DataFrame, keys: str | None = None, zone: str = "UTC", lookups: Lookups | None = None) -> None:
        self.df, self.keys, self.zone, self.lookups = df, keys, zone, lookups or Lookups()

    @classmethod
    def read(cls, spark: SparkSession, path: str, **how) -> Flows:
        from freshet.sources import files

        return cls(normalise(files.read(spark, path, **how)))

    def _new(self, df: DataFrame, keys: str | None = None) -> Flows:
        return Flows(df, keys or self.keys, self.zone, self.lookups)

    def filled(self, columns, must: bool = True) -> Flows:
        """With derived columns that the table lacks: by lookup, or from the payload."""
        df = self.df
        for c in sorted(columns):
            what = {"as": "as", "org": "as", "tor": "tor"}.get(c.rpartition("_")[2], "geo")
            if c in ("ja3", "ja4", "ja4s"):
                df = df if c in df.columns else _fingerprint(df, c)
            elif c in df.columns and what != "as":
                continue
            elif self.lookups.has(what):
                df = self.lookups.fill(df, c)
            elif must and what != "as":
                raise ValueError(f"{c} is asked for, but there is no table to look it up in")
        return self._new(df)

    def filter(self, text: str) -> Flows:
        f = self.filled(derived(parse(text)))
        return self._new(apply_filter(f.df, text, self.zone))

    def window(self, start_ms: int, end_ms: int) -> Flows:
        from freshet.sources.files import in_window

        return self._new(self.df.where(in_window(start_ms, end_ms)))

    def first(self, n: int) -> Flows:
        return self._new(self.df.orderBy("rec_no").limit(n))

    def aggregate(self, keys: str | None = None, first: list[str] | None = None) -> Flows:
        names = [x.strip().lower().partition("/")[0] for x in (keys or "").split(",")]
        df = self.filled({c for n in names for c in agg.KEYS.get(n, ()) if c in DERIVED or c in ("src_as", "dst_as")}).df
        return self._new(agg.aggregate(df, keys, first), keys)

    def bidirectional(self) -> Flows:
        return self._new(agg.bidirectional(self.df))

    def guess_direction(self) -> Flows:
        return self._new(agg.guess_direction(self.df))

    def top(self, n: int = 10, order: str = "bytes", post_filter: str | None = None, filter_first: bool = False) -> Flows:
        ties = [c for c in self.df.columns if c not in ("in_payload", "out_payload", "mpls", "ingress_acl", "egress_acl")]
        return self._new(agg.top(self.df, order, n, ties, post_filter, filter_first))

    def order(self, order: str) -> Flows:
        return self.top(0, order)

    def stat(self, *requests: str, n: int = 10) -> DataFrame:
        names = {stat.parse_request(r).name for r in requests}
        df = self.filled({c for n in names for c in stat.ELEMENTS[n][1] if c in DERIVED or c in ("src_as", "dst_as")}).df
        return stat.top_n(df, list(requests), n)

    def summary(self) -> DataFrame:
        return summary.summary(self.df)

    def anonymize(self, key: str, side: str = "both") -> Flows:
        from freshet.functions.cryptopan import anonymize

        return self._new(anonymize(self.df, key, side))

    def fmt(self, text: str | None = None, **how) -> DataFrame:
        text = text or (tokens.auto_format(self.keys) if self.keys else "line")
        return tokens.fmt(self._shown(text, how), text, **how)

    def csv(self, text: str = "csv", **how) -> DataFrame:
        return tokens.csv(self._shown(text, how), text, **how)

    def _shown(self, text: str, how: dict) -> DataFrame:
        asked = {c for kind, x in tokens.parts(text, how.get("user")) if kind == "token" for c in SHOWN.get(x, ())}
        return self.filled(asked, must=False).df

    def ndjson(self) -> DataFrame:
        return json_out.ndjson(self.df)

    def write(self, path: str, **how) -> None:
        from freshet.sources import files

        files.write(self.df, path, **how)


def _fingerprint(df: DataFrame, name: str) -> DataFrame:
    from freshet.functions import payload
    from freshet.schema import field

    return df.withColumn(name, F.coalesce(*[payload.tls(field(df, p))[name] for p in ("in_payload", "out_payload")]))
