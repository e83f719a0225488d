"""All registered queries: key -> (function of the fleet's tables, checking SQL or None)."""

from . import cat_forecast, cat_loading, cat_models, cat_reads, cat_rest, cat_scoring
from .sqltext import with_ctes
from .store import Fleet, portable

MODULES = [cat_loading, cat_reads, cat_scoring, cat_forecast, cat_models, cat_rest]


def _entries():
    for module in MODULES:
        yield from module.ENTRIES.items()


def queries():
    def bind(build):
        return lambda spark, sf_dir: portable(build(Fleet.of(spark, sf_dir)))

    return {key: bind(build) for key, (build, _) in _entries()}


def oracle_sql():
    return {key: with_ctes(sql) for key, (_, sql) in _entries() if sql is not None}
