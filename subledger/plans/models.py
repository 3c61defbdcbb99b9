"""Models by name: what each is built from, and whether it is kept as a table.

A model is built once, after everything it needs. A table is written under a path of its own
and swapped into place; what its build staged on the way is removed once it is written. A view
is a plan over what it needs and must not stage anything.
"""

from collections.abc import Callable, Collection, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from subledger.sources.shared_folder import replaced, scratch

VIEW, TABLE = "view", "table"


@dataclass(frozen=True)
class Model:
    """``build`` takes the tables named in ``needs``, in their order."""

    name: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]
    kept: str = VIEW
    folder: str = "models"


class BadModels(ValueError):
    """Models that need something nobody has, or each other, or share a name."""


def in_order(models: Iterable[Model], given: Collection[str]) -> list[Model]:
    """Each model after what it needs, otherwise in the order of the list."""
    by_name: dict[str, Model] = {}
    for model in models:
        if model.name in by_name or model.name in given:
            raise BadModels(f"{model.name} is there twice")
        by_name[model.name] = model
    placed: dict[str, Model] = {}

    def place(name: str, readers: tuple[str, ...]) -> None:
        if name in placed or name in given:
            return
        if name in readers:
            raise BadModels(" needs ".join([*readers[readers.index(name) :], name]))
        if name not in by_name:
            raise BadModels(f"{readers[-1]} needs {name}, which there is not")
        for need in by_name[name].needs:
            place(need, (*readers, name))
        placed[name] = by_name[name]

    for name in by_name:
        place(name, ())
    return list(placed.values())


def needed(models: Iterable[Model], wanted: Iterable[str]) -> list[Model]:
    """The wanted models and those they are built from."""
    by_name, found = {m.name: m for m in models}, []
    open_names = list(wanted)
    while open_names:
        name = open_names.pop()
        if name in by_name and by_name[name] not in found:
            found.append(by_name[name])
            open_names += by_name[name].needs
    return [m for m in by_name.values() if m in found]


def materialised(
    spark: SparkSession, models: Iterable[Model], given: Mapping[str, DataFrame], root: str
) -> dict[str, DataFrame]:
    """All models by name; tables lie at ``root/folder/name``, and each model is a temporary view."""
    tables = dict(given)
    ordered = in_order(models, given)
    for model in ordered:
        inputs = [tables[name] for name in model.needs]
        if model.kept == TABLE:
            with scratch(spark):
                tables[model.name] = replaced(model.build(*inputs), f"{root}/{model.folder}/{model.name}")
        else:
            tables[model.name] = model.build(*inputs)
        tables[model.name].createOrReplaceTempView(model.name)
    return {model.name: tables[model.name] for model in ordered}
