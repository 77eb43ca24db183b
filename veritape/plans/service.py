"""What a thin service calls: listing, cached analysis, chat. Requests are validated on the driver; everything else is a plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritape.models import hashed_embedding
from veritape.operators.fuzzy import lookup
from veritape.operators.retrieval import chat_context
from veritape.sinks import Store

MODES = ("full", "earnings", "financial")
NO_CONTEXT = "No relevant transcript data was found for this question."


def validate(body: dict | None, mode_required: bool = True) -> tuple[dict | None, str | None]:
    """(request, None) or (None, error)."""
    body = body or {}
    company = str(body.get("company") or "").strip()
    mode = str(body.get("mode") or "full").strip().lower()
    if not company:
        return None, "company is required"
    if mode_required and mode not in MODES:
        return None, f"mode must be one of {', '.join(MODES)}"
    return {"company": company, "mode": mode}, None


def known_companies(store: Store) -> DataFrame:
    return store.companies(ready=True).select("id", F.col("display_name").alias("name"), F.col("folder_name").alias("folder"))


def find_company(store: Store, name: str) -> DataFrame:
    return lookup(store.companies(ready=True), ["display_name", "folder_name"], "display_name", name)


def analyse(store: Store, name: str, mode: str = "full") -> tuple[int, dict]:
    """(status, body) as the service answers: the cached payload, or why there is none."""
    found = find_company(store, name).first()
    if found is None:
        return 404, {"status": "not_found"}
    row = store.analysis(found.id, mode).select("result_json").first()
    return (404, {"status": "not_cached", "company": found.display_name}) if row is None else (200, {"status": "ok", "company": found.display_name, "result_json": row.result_json})


def chat(store: Store, name: str, query: str | list[float], answer: Callable[[str], str], k: int = 6, embed: Callable[[Column], Column] = hashed_embedding) -> tuple[int, dict]:
    """The answer to a question, from the company's ``k`` nearest sentences. A question in words is embedded as the sentences
    were; a vector is taken as it is. Errors of the model are part of the answer."""
    found = find_company(store, name).first()
    if found is None:
        return 404, {"status": "not_found"}
    if isinstance(query, str):
        query = store.spark.createDataFrame([(query,)], "question string").select(embed(F.col("question")).alias("v")).first().v
    near = store.nearest(query, k, F.col("company").isin(found.display_name, found.folder_name))
    near = near.withColumns({"quarter": F.col("metadata")["quarter"], "result": F.col("metadata")["result"]})
    context = chat_context(near).first().context
    if not context:
        return 200, {"answer": NO_CONTEXT}
    try:
        return 200, {"answer": answer(context)}
    except Exception as e:  # noqa: BLE001  shown to the caller
        return 200, {"answer": f"The model failed: {e}"}
