"""Report, measure and data-quality operators over the retail star schema."""
