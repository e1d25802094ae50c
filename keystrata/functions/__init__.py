"""Value semantics and scalar kernels."""
