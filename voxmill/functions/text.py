"""Column functions for identifiers, captions, mesh text and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the mesh text format: the largest Z-order code and the caption of an object without one.
MORTON_TOP, DEFAULT_CAPTION = 32767, "A 3D object."


def canonical_key(path: Column) -> Column:
    """Web addresses become what follows their last slash; other paths get forward slashes, no leading and no doubled ones."""
    raw = F.regexp_replace(F.trim(path), r"\\", "/")
    plain = F.regexp_replace(F.regexp_replace(raw, r"/{2,}", "/"), r"^/+", "")
    return F.when(raw.rlike(r"^https?://"), base_name(raw)).otherwise(plain)


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def stable_bucket(text: Column, buckets: int = 10000) -> Column:
    """Bucket by the first 16 hex digits of SHA-1, the same on any worker count."""
    high = F.conv(F.substring(F.sha1(text), 1, 16), 16, 10).cast("decimal(20,0)")
    return (high % buckets).cast("long")


def captions(raw: Column) -> Column:
    """Captions of a JSON list, a JSON scalar or plain text; blanks go; at least the default caption."""
    listed = F.from_json(raw, "array<string>")
    scalar = F.when(raw.rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit('{"a":'), raw, F.lit("}")), "$.a"))
    found = F.when(raw.rlike(r"^\s*\["), listed).when(scalar.isNotNull(), F.array(scalar)).otherwise(F.array(raw))
    clean = F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.coalesce(F.size(clean), F.lit(0)) > 0, clean).otherwise(F.array(F.lit(DEFAULT_CAPTION)))


def mesh_text(pairs: Column) -> Column:
    """Mesh text of an array of (morton, id) structs."""
    body = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("<morton_"), p["morton"].cast("string"), F.lit("><mesh_"), p["id"].cast("string"), F.lit(">"))), "")
    return F.concat(F.lit("<mesh_start>"), body, F.lit("<mesh_end>"))


_PAIR = r"<morton_(\d+)>\s*<mesh_(\d+)>"


def mesh_pairs(text: Column, ids: int | None = None) -> Column:
    """Struct of pairs (array of (morton, id)) and dropped: broken pairs, plus Morton and mesh tokens outside any pair. Ids are below ``ids``, if given."""
    codes = F.regexp_extract_all(text, F.lit(_PAIR), 1)
    found = F.regexp_extract_all(text, F.lit(_PAIR), 2)
    both = F.zip_with(codes, found, lambda m, i: F.struct(m.cast("long").alias("morton"), i.cast("long").alias("id")))
    fine = F.filter(both, lambda p: (p["morton"] <= MORTON_TOP) & (F.lit(True) if ids is None else p["id"] < ids))
    lone = F.regexp_count(text, F.lit(r"<morton_\d+>")) + F.regexp_count(text, F.lit(r"<mesh_\d+>")) - 2 * F.size(both)
    return F.struct(fine.alias("pairs"), (F.size(both) - F.size(fine) + lone).alias("dropped"))


def vocabulary(ids: int, top_morton: int = MORTON_TOP) -> Column:
    """Comma list of all mesh tokens: three markers, the codes, the ids."""
    tokens = lambda kind, n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.concat(F.lit(f"<{kind}_"), i.cast("string"), F.lit(">")))
    return F.array_join(F.concat(F.array(*map(F.lit, ("<mesh_start>", "<mesh_end>", "<mesh_empty>"))), tokens("morton", top_morton), tokens("mesh", ids - 1)), ",")


def chat_rows(mesh: Column, caption: Column, ask_caption: str, ask_mesh: str, multiturn: bool = False, task: str = "both") -> Column:
    """Array of rows, each an array of (role, content): one of four turns, or up to two of two turns."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    describe = [turn("user", F.concat(mesh, F.lit("\n" + ask_caption))), turn("assistant", caption)]
    rebuild = [turn("user", F.concat(caption, F.lit("\n" + ask_mesh))), turn("assistant", mesh)]
    if multiturn:
        return F.array(F.array(*describe, *rebuild))
    rows = [F.array(*t) for t, kinds in ((describe, ("both", "caption_only")), (rebuild, ("both", "reconstruct_only"))) if task in kinds]
    return F.array(*rows)


def replace_blocks(blocks: Column, mapping: Column) -> Column:
    """Blocks looked up in a map; unknown ones stay."""
    return F.transform(blocks, lambda b: F.coalesce(F.try_element_at(mapping, b), b))
