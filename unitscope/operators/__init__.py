"""DataFrame operators on tensors, concept labels, rates and graphs."""
