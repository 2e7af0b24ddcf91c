"""Class names and dependencies of Java sources by regular expressions, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The patterns define which declarations count.  (?U): word characters of all scripts.
CLASS = r"(?U)(?:public\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)"
IMPORT = r"(?U)import\s+([\w.]+)\s*;"
PARENT = r"(?U)(?:extends|implements)\s+([\w,\s]+?)(?:\{|$)"
MEMBER = r"(?U)(?:private|protected|public)\s+(\w+)\s+\w+\s*[;=,\(]"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.java$", "")


def dotted(path: Column, root: str) -> Column:
    """Path below ``root`` as a qualified class name."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit(root.rstrip("/") + "/"), F.lit("")), r"\.java$", ""), "/", ".")


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def class_name(source: Column, path: Column) -> Column:
    found = F.regexp_extract(source, CLASS, 1)
    return F.when(found == "", stem(path)).otherwise(found)


def imports(source: Column) -> Column:
    return F.transform(F.regexp_extract_all(source, F.lit(IMPORT), F.lit(1)), last_part)


def parents(source: Column) -> Column:
    clauses = F.regexp_extract_all(source, F.lit(PARENT), F.lit(1))
    return F.filter(F.flatten(F.transform(clauses, lambda c: F.split(c, r"[,\s]+"))), lambda x: x != "")


def members(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(MEMBER), F.lit(1))


def dependencies(source: Column, own: Column) -> Column:
    """Distinct simple names that a source refers to, without its own."""
    return F.array_remove(F.array_distinct(F.concat(imports(source), parents(source), members(source))), own)
