"""A registry of named functions over a session, and an executor that reports failures."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Tool:
    name: str
    run: Callable[[SparkSession, dict], DataFrame]
    description: str = ""
    required: tuple[str, ...] = ()


@dataclass
class ToolRegistry:
    """Tools by `namespace.name`; registering a name again replaces it."""

    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, tool: Tool) -> None:
        if tool.name.count(".") != 1:
            raise ValueError(f"a tool's name is namespace.name, not {tool.name}")
        self.tools[tool.name] = tool

    def namespaces(self) -> list[str]:
        return sorted({n.split(".")[0] for n in self.tools})

    def of(self, namespace: str) -> list[Tool]:
        return [self.tools[n] for n in sorted(self.tools) if n.startswith(f"{namespace}.")]

    def exported(self) -> list[dict]:
        """Definitions as a language model's function call wants them."""
        return [{"name": t.name, "description": t.description, "parameters": {"type": "object", "required": list(t.required)}} for t in map(self.tools.get, sorted(self.tools))]

    def execute(self, spark: SparkSession, calls: list[tuple[str, dict]]) -> DataFrame:
        """tool, success, rows, error, seconds of each call, in order; failures are rows too."""
        out = []
        for name, arguments in calls:
            began = time.time()
            try:
                tool = self.tools[name]
                if lacking := [p for p in tool.required if p not in arguments]:
                    raise ValueError(f"missing: {', '.join(lacking)}")
                out.append((name, True, tool.run(spark, arguments).count(), None, time.time() - began))
            except Exception as e:  # a tool may fail in any way
                out.append((name, False, None, f"{type(e).__name__}: {e}".splitlines()[0], time.time() - began))
        return spark.createDataFrame(out, "tool string, success boolean, rows long, error string, seconds double")


@dataclass
class Services:
    """Providers of services by name; which one is used can be switched at run time."""

    providers: dict[str, dict[str, object]] = field(default_factory=dict)
    chosen: dict[str, str] = field(default_factory=dict)

    def register(self, service: str, provider: str, value: object) -> None:
        """The first provider of a service is used until another is chosen."""
        self.providers.setdefault(service, {})[provider] = value
        self.chosen.setdefault(service, provider)

    def switch(self, service: str, provider: str) -> None:
        if provider not in self.providers.get(service, {}):
            raise KeyError(f"{service} has no provider {provider}")
        self.chosen[service] = provider

    def get(self, service: str) -> object:
        if service not in self.chosen:
            raise KeyError(f"there is no service {service}")
        return self.providers[service][self.chosen[service]]


@dataclass
class Servers:
    """Registries of tools by namespace: a call goes to the server of its tool's namespace."""

    servers: dict[str, ToolRegistry] = field(default_factory=dict)

    def mount(self, namespace: str, registry: ToolRegistry) -> None:
        self.servers[namespace] = registry

    def route(self, tool: str) -> ToolRegistry:
        namespace = tool.split(".")[0]
        if namespace not in self.servers:
            raise KeyError(f"no server has the namespace {namespace}")
        return self.servers[namespace]

    def execute(self, spark: SparkSession, calls: list[tuple[str, dict]]) -> DataFrame:
        """As ToolRegistry.execute; a call that no server takes is a failed row."""
        every = ToolRegistry({n: t for r in self.servers.values() for n, t in r.tools.items() if n.split(".")[0] in self.servers})
        return every.execute(spark, calls)


TASKS = "uuid string, title string, priority string, due_date timestamp_ntz, description string, completed boolean"


def register_tasks(registry: ToolRegistry, store, now) -> None:
    """task.create, task.complete and task.list over the table `tasks` of a store; `now` is a Column."""
    import uuid

    from pyspark.sql import functions as F

    from .functions import times
    from .operators import finders

    def stored() -> DataFrame:
        return store.read("tasks") if "tasks" in store.tables() else store.spark.createDataFrame([], TASKS)

    def create(spark: SparkSession, given: dict) -> DataFrame:
        if not given.get("title"):
            raise ValueError("a task needs a title")
        row = (str(uuid.uuid4()), given["title"], given.get("priority") or "medium", given.get("dueDate"), given.get("description"), False)
        made = spark.createDataFrame([row], TASKS.replace("timestamp_ntz", "string")).withColumn("due_date", times.from_iso(F.col("due_date")))
        store.save("tasks", made)
        return stored().filter(F.col("uuid") == row[0])

    def complete(spark: SparkSession, given: dict) -> DataFrame:
        if not given.get("taskId"):
            raise ValueError("taskId is required")
        found = stored().filter(F.col("uuid") == given["taskId"])
        if found.isEmpty():
            raise ValueError(f"there is no task {given['taskId']}")
        store.save("tasks", found.withColumn("completed", finders.task_state(F.col("completed"), F.lit("complete"))))
        return stored().filter(F.col("uuid") == given["taskId"])

    def listed(spark: SparkSession, given: dict) -> DataFrame:
        return finders.tasks(stored(), given.get("filter") or "all", now)

    registry.register(Tool("task.create", create, "Create a task from a title, a priority, a due date and a description", ("title",)))
    registry.register(Tool("task.complete", complete, "Mark a task as completed", ("taskId",)))
    registry.register(Tool("task.list", listed, "List tasks: all, incomplete, completed, overdue, today, soon, high_priority"))
