"""Questions answered by tools over the graph and the vectors, called by a chat model in a bounded loop."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.models import ChatModel
from ..functions.text import SIMPLE, terms
from ..functions.vectors import hashed_embedding
from ..operators import graph_query as g
from ..operators.vector import by_metadata, top_by_cosine

SOURCES = ("jira", "github", "confluence", "logs")
SYSTEM = "You answer engineers' questions from tickets, commits, documentation and logs. Look things up with the tools, name ids of what you found, and say whom to contact."


@dataclass
class Store:
    """What the tools read."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    resolved: bool = False

    def semantic_search(self, query: str, source_filter: str | None = None, k: int = 4) -> DataFrame:
        spark = self.vectors.sparkSession
        q = spark.range(1).select(hashed_embedding(terms(F.lit(query))).alias("q")).first().q
        best = top_by_cosine(self.vectors, q, k, where=by_metadata(source_filter))
        return best.join(self.vectors.drop("embedding"), "id").orderBy("rank")

    def get_service_context(self, service_name: str) -> DataFrame:
        known = g.service_node(self.nodes, service_name).first()
        return g.context(self.nodes, self.edges, known.id if known else f"service__{service_name.replace('-', '_')}", 2, 10)

    def find_owner(self, service_name: str) -> DataFrame:
        return g.find_owner(self.nodes, self.edges, service_name, self.resolved)

    def get_recent_changes(self, service_name: str) -> DataFrame:
        return g.recent_changes(self.nodes, self.edges, service_name)

    def get_active_incidents(self, service_name: str) -> DataFrame:
        return g.active_incidents(self.nodes, self.edges, service_name, self.resolved)

    def get_dependencies(self, service_name: str) -> DataFrame:
        return g.dependencies(self.nodes, service_name, self.resolved)


#: The tools' names and parameters.
_SERVICE = {"type": "object", "properties": {"service_name": {"type": "string"}}, "required": ["service_name"]}
_QUERY = {"type": "object", "properties": {"query": {"type": "string"}, "source_filter": {"type": "string", "enum": list(SOURCES)}}, "required": ["query"]}
TOOLS = [
    {"name": "semantic_search", "description": "Records whose meaning is near a query.", "parameters": _QUERY},
    {"name": "get_service_context", "description": "Everything within two steps of a service.", "parameters": _SERVICE},
    {"name": "find_owner", "description": "Who owns a service, and whom to escalate to.", "parameters": _SERVICE},
    {"name": "get_recent_changes", "description": "The latest commits that touch a service.", "parameters": _SERVICE},
    {"name": "get_active_incidents", "description": "Open tickets about a service, by priority.", "parameters": _SERVICE},
    {"name": "get_dependencies", "description": "What a service depends on.", "parameters": _SERVICE},
]


def run_tool(store: Store, name: str, inputs: dict, most: int = Config.tool_rows) -> str:
    """The tool's rows as JSON, `most` of them, or {"error": ...}."""
    if name not in {t["name"] for t in TOOLS}:
        return json.dumps({"error": f"Unknown tool: {name}"})
    try:
        rows = [json.loads(r) for r in getattr(store, name)(**inputs).limit(most).toJSON().collect()]
        return json.dumps({"dependencies": [r["dependency"] for r in rows]} if name == "get_dependencies" else rows)
    except Exception as e:
        return json.dumps({"error": str(e)})


def is_simple_question(question: str) -> bool:
    return question.lower().startswith(SIMPLE) and len(question.split()) < 8


@dataclass
class Offline:
    """A chat model that plans by rule: it searches, looks up the services it is told of, then answers with what it found."""

    services: tuple[str, ...] = ()
    asked: list = field(default_factory=list)

    def turn(self, messages: list[dict], tools: list[dict]) -> dict:
        question = next(m["content"] for m in messages if m["role"] == "user")
        if tools and not self.asked:
            self.asked = [("semantic_search", {"query": question})]
            for s in self.services:
                if s in question.lower():
                    self.asked += [(t, {"service_name": s}) for t in ("find_owner", "get_recent_changes", "get_active_incidents")]
            return {"content": None, "tools": [{"name": n, "input": i} for n, i in self.asked]}
        found = [m["content"] for m in messages if m["role"] == "tool"]
        return {"content": "\n".join(found) if found else messages[-1]["content"], "tools": []}


class Talk:
    """A conversation about one question, and the tool calls that were made for it."""

    def __init__(self, question: str, store: Store, config: Config, log: Callable[[str], None]):
        self.store, self.config, self.log = store, config, log
        self.messages: list[dict] = [{"role": "system", "content": SYSTEM}]
        self.calls: list[dict] = []
        self.answer = ""
        self.tell("user", question)

    def tell(self, role: str, content: str, **more: object) -> None:
        self.messages.append({"role": role, "content": content} | more)

    @property
    def spent(self) -> bool:
        return len(self.calls) >= self.config.max_tool_calls

    def look_up(self, name: str, inputs: dict, **more: object) -> None:
        """Call a tool and tell the model what came of it; calls made before, and those beyond the cap, are only remarked on."""
        call = {"tool": name, "input": inputs}
        if call in self.calls:
            found = json.dumps({"note": "a repeated call; its result is above"})
        elif self.spent:
            found = json.dumps({"note": "the limit of tool calls is reached"})
        else:
            self.calls.append(call)
            self.log(f"{len(self.calls)}/{self.config.max_tool_calls} {name}")
            found = run_tool(self.store, name, inputs | more, self.config.tool_rows)
        self.tell("tool", found, name=name)

    def turn(self, model: ChatModel, tools: list[dict]) -> list[dict]:
        """The model's turn: what it says last is the answer; what it asks for is returned."""
        said = model.turn(self.messages, tools)
        self.answer = said.get("content") or self.answer
        self.tell("assistant", said.get("content"), tools=said.get("tools") or [])
        return self.messages[-1]["tools"]

    def result(self, stopped: bool) -> dict:
        #: The keys of an answer.
        return {"answer": self.answer, "tools_called": self.calls, "tool_call_count": len(self.calls), "stopped_early": stopped}


def run_agent(question: str, store: Store, model: ChatModel, config: Config = Config(), log: Callable[[str], None] = lambda s: None) -> dict:
    """answer, tools_called, tool_call_count, stopped_early.

    A simple question is looked up once, and answered in one turn. Else the model calls tools until it asks for
    none or the cap is reached, which holds within a turn too; it has twice as many turns as calls.
    """
    talk = Talk(question, store, config, log)
    if is_simple_question(question):
        talk.look_up("semantic_search", {"query": question}, k=3)
        talk.turn(model, [])
        return talk.result(False)
    for _ in range(2 * config.max_tool_calls):
        wanted = talk.turn(model, TOOLS)
        for call in wanted:
            talk.look_up(call["name"], call["input"])
        if not wanted or talk.spent:
            break
    if wanted:
        talk.tell("user", "No more tools can be called. Answer with what you have.")
        talk.turn(model, [])
    return talk.result(bool(wanted))
