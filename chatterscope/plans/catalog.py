"""All queries of the reference's operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a query under the operators' ids it covers, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


from chatterscope.plans import accounts, audits, extra, market, opinions, resumed, selection, streams, text, upkeep  # noqa: E402, F401  they register themselves
