"""File and class names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Image file endings. The first set is matched as written, the second in lower case.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".bmp", ".JPG", ".JPEG", ".PNG")
IMAGE_ENDINGS_WIDE = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")


def decoded(path: Column) -> Column:
    """File paths come URL-encoded from the file sources; a plus sign stays a plus sign."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem(name: Column) -> Column:
    """File name without its last ending; a leading dot does not start an ending."""
    return F.regexp_replace(file_name(name), r"(?<=.)\.[^.]*$", "")


def ends_with_any(name: Column, endings, ignore_case: bool = False) -> Column:
    name = F.lower(name) if ignore_case else name
    return F.regexp_extract(name, r"(?<=[^/])(\.[^./]*)$", 1).isin(*endings)


def label_path(image_path: Column, root: Column) -> Column:
    """The label file that belongs to an image.

    Below an ``images`` folder the sibling ``labels`` folder is used, elsewhere ``<root>/labels``.
    """
    path = F.replace(image_path, F.lit("\\"), F.lit("/"))
    sibling = F.concat(F.regexp_replace(F.replace(path, F.lit("/images/"), F.lit("/labels/")), r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt"))
    return F.when(F.contains(path, F.lit("/images/")), sibling).otherwise(
        F.concat(root, F.lit("/labels/"), stem(path), F.lit(".txt"))
    )


def normal_name(name: Column) -> Column:
    return F.btrim(F.translate(F.lower(name), "_ ", "--"), F.lit("\t\n\r\f\u000b"))
