"""Named reports and the batch job, composed from the operators."""
