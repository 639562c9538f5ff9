"""Scalar expressions over paths, sizes and flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stocktake.functions.lookups import category_of


def display_size(logical="byte_size", allocated="allocated_size") -> Column:
    return F.greatest(F.col(logical), F.col(allocated))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    """The directory above; that of a first-level entry is ``/``, the root has none."""
    above = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == "/", F.lit(None).cast("string")).when(above == "", F.lit("/")).otherwise(above)


def depth(path: Column) -> Column:
    return F.when(path == "/", F.lit(0)).otherwise(F.size(F.split(path, "/")) - 1)


def path_ancestors(path: Column) -> Column:
    """All strict ancestors from ``/`` down; none for ``/`` itself."""
    parts = F.split(path, "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(path == "/", F.array().cast("array<string>")).otherwise(each)


def ancestors_or_self(path: Column) -> Column:
    return F.concat(path_ancestors(path), F.array(path))


def extension_text(name: Column) -> Column:
    """``file_extension``, but empty for none: a filter that compares it takes the name apart once."""
    return F.lower(F.trim(F.regexp_extract(name, r"^.+\.([^./]+)$", 1)))


def file_extension(name: Column) -> Column:
    """Lower-case last extension; null for none and for names that only begin with a dot."""
    return F.nullif(extension_text(name), F.lit(""))


def entry_kind(symlink: Column, directory: Column, package: Column, regular: Column) -> Column:
    return F.when(symlink, "alias").when(directory & package, "package").when(directory, "folder").when(regular, "file").otherwise("other")


def is_container(kind: Column) -> Column:
    return kind.isin("folder", "package")


def type_label(ext: Column) -> Column:
    return F.coalesce(F.concat(F.lit("."), ext), F.lit("No Extension"))


def type_category(ext: Column) -> Column:
    return category_of(ext)


def relative_path(path: Column, root: str) -> Column:
    """Path below the root; the root maps to its own name, anything outside to itself."""
    top = root.rstrip("/")
    return F.when(path == root, F.lit(top.rsplit("/", 1)[-1])).when(path.startswith(top + "/"), F.substring(path, len(top) + 2, 1 << 30)).otherwise(path)


def below(path: Column, root: str) -> Column:
    """What follows the root in a path under it; empty for the root itself, the whole path for others."""
    top = root.rstrip("/")
    return F.when(path == root, F.lit("")).when(path.startswith(top + "/"), F.substring(path, len(top) + 2, 1 << 30)).otherwise(path)


def natural_key(text: Column) -> Column:
    """Case-insensitive order with numbers by value: digit runs are padded to 20 places."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(runs, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, F.greatest(F.lit(20), F.length(p)), F.lit("0"))).otherwise(p)), "")


def natural_order(text: Column) -> Column:
    """What to sort names by: their natural key in Unicode's order, in which accented letters stand beside plain ones and case does not count."""
    return F.collate(natural_key(text), "UNICODE_CI")


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def prefix_sha256(content: Column, n: int = 65_536) -> Column:
    return F.sha2(F.substring(content, 1, n), 256)


def file_identity(kind="kind", nlink="nlink", device="device", inode="inode", modified="modified_at", changed="ctime") -> Column:
    """device:inode:mtime:ctime of a regular file with one link, else null."""
    whole = F.concat_ws(":", F.col(device), F.col(inode).cast("string"), F.date_format(modified, "yyyy-MM-dd HH:mm:ss"), F.date_format(changed, "yyyy-MM-dd HH:mm:ss"))
    return F.when((F.col(kind) == "file") & (F.col(nlink) == 1) & F.col(device).isNotNull() & F.col(inode).isNotNull(), whole)


def candidate_id(kind: Column, path: Column) -> Column:
    return F.concat_ws("-", kind, path)


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 0).when(confidence == "medium", 1).otherwise(2)


def at_or_under(path: Column, prefix: str) -> Column:
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")
