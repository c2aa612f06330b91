"""Sinks for exchanges, turns and session chunks."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_exchanges(exchanges: DataFrame, out: str) -> None:
    """Parquet, one folder per project."""
    exchanges.write.mode("errorifexists").partitionBy("project").parquet(out)


def exchange_text(kind: Column, session: Column, project: Column, before: Column, user: Column) -> Column:
    """One exchange as text under its header line."""
    return F.concat(F.lit("### "), kind, F.lit(" s="), session, F.lit(" "), project, F.lit("\nCLAUDE: "), before,
                    F.lit("\nUSER: "), user, F.lit("\n"))


def turn_text(session: Column, project: Column, user: Column, tools: Column, claude: Column) -> Column:
    return F.concat(F.lit("### TURN s="), session, F.lit(" "), project, F.lit("\nUSER: "), user, F.lit("\nTOOLS: "),
                    F.array_join(tools, "; "), F.lit("\nCLAUDE: "), F.coalesce(claude, F.lit("")), F.lit("\n"))


def line_count(text: Column) -> Column:
    """Lines a text takes in the output, the blank line after it included."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def write_session_chunks(rows: DataFrame, chunks: DataFrame, out: str, keys=("project", "session"), order=("seq",)) -> None:
    """Text files in one folder per chunk.

    ``rows``: keys, order columns and ``text``. Range partitions keep the order, and let a long
    session fill several files of its chunk's folder; read by name, the files give the chunk back.
    """
    keys, order = list(keys), list(order)
    placed = rows.join(chunks.select(*keys, "chunk"), keys)
    sort = ["chunk", *keys, *order]
    placed.repartitionByRange(*sort).sortWithinPartitions(*sort).select("chunk", "text").write.mode("errorifexists").partitionBy(
        "chunk").text(out)
