"""The op log as a stream: an addition to the batch engine, which the reference semantics don't ask for."""
