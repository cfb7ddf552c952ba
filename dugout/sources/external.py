"""Team statistics of an external service as a data source: one partition a year, failures skipped."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Year(InputPartition):
    def __init__(self, year: int, division: int):
        self.year, self.division = year, division


class TeamStats(DataSource):
    """``spark.read.format("team_stats")`` with the options ``module`` (an importable module with ``teams(year, division)`` and
    ``stat(name, team, year, division)``), ``stats`` (names, comma between), ``first``, ``last`` and ``division``.

    A team whose list cannot be read and a statistic that cannot be read or is no number are skipped: the year has no rows, the
    value is null. A label is split into team and league by its brackets; one without is passed over."""

    @classmethod
    def name(cls) -> str:
        return "team_stats"

    def schema(self) -> str:
        cols = [f"`{s.strip()}` double" for s in self.options.get("stats", "").split(",") if s.strip()]
        return ", ".join(["team string", "league string", "year int", *cols])

    def reader(self, schema) -> "_Reader":
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[_Year]:
        division = int(self.options.get("division", "1"))
        return [_Year(y, division) for y in range(int(self.options["first"]), int(self.options["last"]) + 1)]

    def read(self, partition: _Year) -> Iterator[tuple]:
        service = importlib.import_module(self.options["module"])
        names = [s.strip() for s in self.options.get("stats", "").split(",") if s.strip()]
        try:
            labels = list(service.teams(partition.year, partition.division))
        except Exception:  # whatever the service raises: the year is skipped
            return
        for label in labels:
            team, bracket, rest = str(label or "").partition("(")
            league = rest.replace(")", "").strip()
            if not bracket or ")" not in rest or not team.strip() or not league or team.strip().lower().startswith("division"):
                continue
            values = []
            for s in names:
                try:
                    values.append(float(service.stat(s, label, partition.year, partition.division)))
                except Exception:  # the same for one value
                    values.append(None)
            yield (team.strip(), league, partition.year, *values)
