"""Results and errors in OData's JSON form, and the OpenAPI parameters of the options."""

from __future__ import annotations

from typing import Any
from urllib.parse import urlencode

from .errors import QueryError, SelectorError, TypeMismatchError, UnsupportedFunctionError
from .fluent import QueryBuilder
from .intent import MAX_SKIP, MAX_TOP
from .lang import options
from .selector import Query, Selector

MESSAGE, EXPRESSION = 512, 256


def collection(selector: Selector, query: Query = None, *, url: str = "", base_df=None) -> dict[str, Any]:
    """context, value, with $count the filter's total, and a link to the next page if this one is full and there may be more."""
    intent = selector.intent(query)
    rows = selector.query_as_dicts(query, base_df)
    out: dict[str, Any] = {"@odata.context": f"{url}/$metadata#{selector.entity.name}"}
    total = selector.count_by(intent, base_df) if intent.count else None
    if total is not None:
        out["@odata.count"] = total
    top = min(selector.policy.default_top if intent.top is None else intent.top, selector.policy.max_top)
    following = (intent.skip or 0) + top
    if not intent.apply and 0 < top == len(rows) and following <= MAX_SKIP and (total is None or following < total):
        given = _given(query)
        if given is not None:
            out["@odata.nextLink"] = f"{url}/{selector.entity.name}?" + urlencode(given | {"$top": str(top), "$skip": str(following)}, safe="$,/()':")
    return out | {"value": rows}


def _given(query: Query) -> dict[str, str] | None:
    """The query's options as text; None if it has none, as a built condition or an intent: then no link is given rather than one to another query."""
    if query is None or isinstance(query, (str, dict)):
        return options.options(query)
    if not isinstance(query, QueryBuilder):
        return None
    try:
        return query.to_dict()
    except ValueError:
        return None


def error(e: SelectorError, query: str = "") -> dict[str, Any]:
    """The body of an HTTP 400."""
    details = [{"code": "expression", "message": e.expression[:EXPRESSION]}] if isinstance(e, QueryError) and e.expression else []
    message = str(e)
    if query.count("$") > 1 and "&" not in query:
        message += " (options are separated by &)"
    code = type(e).__name__
    if isinstance(e, (TypeMismatchError, UnsupportedFunctionError)):
        details.append({"code": "kind", "message": "operands or function"})
    return {"error": {"code": code, "message": message[:MESSAGE], "details": details}}


def parameters(detail: bool = False) -> list[dict[str, Any]]:
    """OpenAPI query parameters; of a single entity only $select and $expand."""
    whole = lambda most: {"type": "integer", "minimum": 0, "maximum": most}
    text = {"type": "string"}
    kinds = {"$select": text, "$expand": text} | ({} if detail else {"$filter": text, "$orderby": text, "$top": whole(MAX_TOP), "$skip": whole(MAX_SKIP), "$count": {"type": "boolean"}})
    return [{"name": n, "in": "query", "required": False, "schema": s} for n, s in kinds.items()]
