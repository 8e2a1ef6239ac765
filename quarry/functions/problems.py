"""Kinds of errors a service answers with, and which kind an exception is."""

from __future__ import annotations

from quarry.functions.params import ParameterError
from quarry.functions.scalars import CursorError, StaleCursorError


class NotFound(LookupError):
    """A record that doesn't exist."""


class NotReady(RuntimeError):
    """No data have been published yet."""


class Conflict(RuntimeError):
    """An operation of this kind is already running."""


#: Kinds with title and status.
KINDS = {
    "invalid_parameter": ("Paramètre invalide", 400),
    "cursor_stale": ("Curseur périmé", 400),
    "unauthorized": ("Authentification requise", 401),
    "not_found": ("Ressource introuvable", 404),
    "not_acceptable": ("Format de réponse non acceptable", 406),
    "rate_limited": ("Quota dépassé", 429),
    "internal_error": ("Erreur interne", 500),
    "not_ready": ("Service non prêt", 503),
    "conflict": ("Opération déjà en cours", 409),
    "payload_too_large": ("Corps de requête trop volumineux", 413),
    "method_not_allowed": ("Méthode non autorisée", 405),
}

_OF = ((StaleCursorError, "cursor_stale"), (CursorError, "invalid_parameter"), (ParameterError, "invalid_parameter"), (NotFound, "not_found"), (NotReady, "not_ready"), (Conflict, "conflict"))


def kind_of(error: BaseException) -> str:
    return next((kind for cls, kind in _OF if isinstance(error, cls)), "internal_error")


def problem(kind: str, detail: str = "", instance: str = "", request_id: str = "", base: str = "") -> dict[str, object]:
    """An error document by RFC 9457; unknown kinds are internal errors. Empty details and instances are left out."""
    kind = kind if kind in KINDS else "internal_error"
    title, status = KINDS[kind]
    out: dict[str, object] = {"type": base + kind, "title": title, "status": status}
    if detail:
        out["detail"] = detail
    if instance:
        out["instance"] = instance
    return out | {"request_id": request_id}


def answer(error: BaseException, instance: str = "", request_id: str = "", base: str = "") -> dict[str, object]:
    """The document of an exception; what went wrong inside isn't told."""
    kind = kind_of(error)
    return problem(kind, "" if kind == "internal_error" else str(error), instance, request_id, base)
