"""Session, storage and size rules that decide how a plan runs."""
