"""Names of models, projects and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE_TAIL = r"-(?:20[0-9]{2}-[0-9]{2}-[0-9]{2}|20[0-9]{6})$"
_UUID_TAIL = r"-?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def without_date(model: Column) -> Column:
    """A model name without its date at the end."""
    return F.regexp_replace(model, _DATE_TAIL, "")


def display_model(model: Column, speed: Column | None = None) -> Column:
    """Placeholder models are null; a fast run says so in its name."""
    real = F.nullif(model, F.lit("<synthetic>"))
    if speed is None:
        return real
    return F.when((speed == "fast") & ~real.endswith("-fast"), F.concat(real, F.lit("-fast"))).otherwise(real)


def aliased(model: Column, aliases: dict[str, str]) -> Column:
    """The name an alias stands for; a -fast at the end is kept."""
    if not aliases:
        return model
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    stem = F.regexp_replace(model, "-fast$", "")
    tail = F.when(model.endswith("-fast"), "-fast").otherwise("")
    return F.coalesce(F.try_element_at(table, model), F.concat(F.try_element_at(table, stem), tail), model)


def parse_aliases(text: str) -> dict[str, str]:
    """a=b,c=d as a dictionary; pairs without a name on either side are left out."""
    pairs = (p.split("=", 1) for p in text.split(",") if "=" in p)
    return {a.strip(): b.strip() for a, b in pairs if a.strip() and b.strip()}


def normal_key(name: Column) -> Column:
    """Separators . and @ count as -."""
    return F.translate(name, ".@", "--")


def project_of(path: Column) -> Column:
    """The path component after projects, else unknown."""
    parts = F.split(path, "[/\\\\]")
    at = F.array_position(parts, "projects").cast("int")
    return F.coalesce(F.when(at > 0, F.nullif(F.try_element_at(parts, at + 1), F.lit(""))), F.lit("unknown"))


def session_of(path: Column) -> Column:
    """The session a file belongs to: its stem, or the folder above subagents."""
    parts = F.split(path, "[/\\\\]")
    nested = F.array_position(parts, "subagents").cast("int")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl?(\.zst)?$", "")
    return F.when(nested > 1, F.try_element_at(parts, nested - 1)).otherwise(stem)


def project_name(folder: Column) -> Column:
    """A folder name for people: without the home prefix, an id at the end, or what follows a double dash."""
    home = F.regexp_replace(folder, r"^-(?:Users|home)-[^-]+-", "")
    cut = F.regexp_replace(F.regexp_replace(home, _UUID_TAIL, ""), r"--.*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(cut, r"^-+|-+$", ""), F.lit("")), folder)


def decoded(path: Column) -> Column:
    """%XX sequences as the characters they stand for."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)


def reset_seconds(text: Column) -> Column:
    """Epoch seconds at which a usage limit ends, from the error's text."""
    return F.nullif(F.regexp_extract(text, r"usage limit reached\|([0-9]{1,18})", 1), F.lit("")).cast("bigint")


def grouped(number: Column) -> Column:
    """1,234."""
    return F.format_number(number, 0)


def dollars(amount: Column) -> Column:
    return F.format_string("$%.2f", amount)
