"""Token usage from logs: cumulative counters to deltas and duplicate usage records."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.reduce import reduce_sessions

COUNTERS = ("input", "output", "reasoning", "cached")


def token_deltas(records: DataFrame) -> DataFrame:
    """(ref, line, input, output, reasoning, cached) from records with cumulative total_* and optional last_* counters.

    A record whose cumulative total repeats is skipped and changes nothing; last_* wins over differences;
    negative differences count as zero; records without any tokens are dropped. What counts as previous
    depends on the records skipped, so sessions are reduced in order, one at a time.
    """

    def reduce_session(rows: list[dict]) -> list[tuple]:
        seen_total, seen, out = 0, dict.fromkeys(COUNTERS, 0), []
        for r in rows:
            number = lambda c: max(0, int(r[c] or 0))  # noqa: B023, E731
            total = number("total")
            if total and total == seen_total:
                continue
            if r["last_input"] is not None:
                got = {c: number(f"last_{c}") for c in COUNTERS}
            elif total:
                got = {c: max(0, number(f"total_{c}") - seen[c]) for c in COUNTERS}
            else:
                continue
            if r["total_input"] is not None:
                seen = {c: number(f"total_{c}") for c in COUNTERS}
            seen_total = total or seen_total
            if any(got.values()):
                out.append((r["ref"], int(r["line"]), *got.values()))
        return out

    return reduce_sessions(records, "line", reduce_session, "ref string, line long, input long, output long, reasoning long, cached long")


def first_usage(records: DataFrame) -> DataFrame:
    """Usage counted once for each request of a session: the first record by line."""
    return records.groupBy("ref", "request").agg(F.min_by(F.struct("input", "output"), "line").alias("u"), F.min("line").alias("line")).select("ref", "request", "line", "u.input", "u.output")


def digest_chain(messages: DataFrame) -> DataFrame:
    """(ref, message_index, digest): SHA-256 of the previous digest and the length-prefixed fields; a fold in message order."""

    def chain(rows: list[dict]) -> list[tuple]:
        import hashlib

        last, out = "", []
        for r in rows:
            fields = [last, str(r["message_index"]), r["role"] or "", r["text"] or ""]
            last = hashlib.sha256("".join(f"{len(x.encode())}:{x}" for x in fields).encode()).hexdigest()
            out.append((r["ref"], r["message_index"], last))
        return out

    return reduce_sessions(messages.select("ref", "message_index", "role", "text"), "message_index", chain, "ref string, message_index long, digest string")
