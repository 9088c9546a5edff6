"""Ownership and sharing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def owned_by(owner: Column, user) -> Column:
    return F.coalesce(owner == user, F.lit(False))


def accessible_by(owner: Column, visibility: Column, shared: Column, user) -> Column:
    """The owner's, public, or shared with the user (also while private)."""
    return owned_by(owner, user) | F.coalesce(visibility == "public", F.lit(False)) | F.coalesce(F.array_contains(shared, user), F.lit(False))


def share(shared: Column, user) -> Column:
    return F.array_union(F.coalesce(shared, F.array().cast("array<bigint>")), F.array(F.lit(user).cast("long")))


def unshare(shared: Column, user) -> Column:
    return F.array_remove(shared, F.lit(user).cast("long"))


def made_public(owner: Column, visibility: Column, user) -> Column:
    """Visibility after the user makes a row public: only the owner can."""
    return F.when(owned_by(owner, user), "public").otherwise(visibility)


def made_private(owner: Column, visibility: Column, user) -> Column:
    """Visibility after the user makes a row private; whom it is shared with stays."""
    return F.when(owned_by(owner, user), "private").otherwise(visibility)
