"""Feature tables, model pipelines, evaluation loops and the named feature/model combinations."""
