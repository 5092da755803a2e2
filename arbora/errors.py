"""What a workspace raises."""


class AnalysisError(Exception):
    """Base of all errors of this package; ``code`` goes into error documents."""

    code = "error"


class NotOpen(AnalysisError):
    code = "project_not_open"


class NotFound(AnalysisError):
    code = "symbol_not_found"


class Ambiguous(AnalysisError):
    code = "ambiguous_symbol"


class OutsideProject(AnalysisError):
    code = "path_outside_project"


def document(error: Exception) -> dict:
    """An exception as a document."""
    return {"error": str(error), "error_code": error.code if isinstance(error, AnalysisError) else "error"}
