"""Query plans composed from operators: search, dispatch, evaluation."""
